"""Balanced splits and merged terms against plain rules."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandtable.operators import aggregates, hierarchy


@pytest.mark.parametrize(("n", "batch"), [(3, 40), (7, 150), (2, 9)])
def test_splits_with_validation_by_brute_force(spark, n, batch):
    """One label of nine tenths of the rows, one smaller than a batch, one between one and two batches."""
    rows = [(i, "hot") for i in range(900)] + [(1000 + i, "small") for i in range(30)] + [(2000 + i, "mid") for i in range(70)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = defaultdict(list)
    for r in aggregates.balanced_splits(df, n, batch, validation=True, cover=True).collect():
        got[r.split, r.part, r.label].append(r.id)
    n = max(n, -(-900 // batch))
    seen = set()
    for label in ("hot", "small", "mid"):
        ids = sorted((i for i, x in rows if x == label), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))
        for s in range(n):
            train = [ids[(s * batch + i) % len(ids)] for i in range(batch)]
            spare = [ids[((s + 1) * batch + i) % len(ids)] for i in range(max(0, min(batch, len(ids) - batch)))]
            assert sorted(got[s, "train", label]) == sorted(train) and sorted(got[s, "validation", label]) == sorted(spare)
            assert not set(train) & set(spare)
            seen |= set(train) if label == "hot" else set()
    assert len(seen) == 900 and max(s for s, _, _ in got) == n - 1
    plain = aggregates.balanced_splits(df, n, batch)
    assert plain.columns == ["split", "label", "id"] and plain.count() == 3 * n * batch


def plain_terms(edges, listed, most):
    """The sequential rule, one leaf and one step at a time."""
    above = defaultdict(set)
    for p, c in edges:
        above[c].add(p)

    def ancestors(x):
        depth, front = {x: 0}, [x]
        while front:
            front = [p for y in front for p in sorted(above[y]) if depth.setdefault(p, depth[y] + 1) == depth[y] + 1 and p not in (x, y)]
            front = list(dict.fromkeys(front))
        return {k: v for k, v in depth.items() if k != x and k in listed}

    up = {x: ancestors(x) for x in listed}
    parents = {p for x in listed for p in up[x]}
    leaves = sorted(set(listed) - parents)
    count = defaultdict(int)
    for x in leaves:
        for p in up[x]:
            count[p] += 1
    aside = {p for p, k in count.items() if k > 1}
    members, tops = {x: x for x in leaves}, {x: x for x in leaves}
    for leaf in leaves:
        start = top = leaf
        while True:
            options = sorted((d, p) for p, d in up[top].items() if p not in aside and p not in members)
            if not options:
                break
            d, p = options[0]
            if d > most:
                start = p
            members[p], tops[start], top = start, p, p
    grown = set(tops)
    for x in sorted(set(listed) - aside - set(members)):
        members[x], tops[x] = x, x
    lowest = sorted(s for s in aside if not any(s in up[o] for o in aside if o != s))
    for s in lowest:
        met = [c for c in sorted(grown) if s in up[tops[c]] and up[tops[c]][s] <= most and tops[c] not in lowest]
        for c in met:
            tops[c] = s
        if met:
            members[s] = met[0]
    named = {x: tops[c] for x, c in members.items()}
    order = {r: k for k, r in enumerate(sorted(set(named.values())))}
    return {(x, order[r], r) for x, r in named.items()}


@pytest.mark.parametrize(("seed", "most"), [(1, 1), (2, 2), (3, 3), (4, 2)])
def test_terms_merge_as_by_the_sequential_rule(spark, seed, most):
    """200 listed terms of a graph of 400, in which a term may have two parents."""
    rng = np.random.default_rng(seed)
    names = [f"t{i:03d}" for i in range(400)]
    edges = {(names[int(rng.integers(max(0, i - 60), i))], names[i]) for i in range(1, 400)} | {(names[int(rng.integers(0, i))], names[i]) for i in rng.integers(5, 400, 25).tolist()}
    listed = sorted(rng.choice(names, 200, replace=False).tolist())
    frame = spark.createDataFrame(sorted(edges), "parent string, child string")
    got = {(r.node, r.cluster, r.representative) for r in hierarchy.simplify_terms(frame, spark.createDataFrame([(x,) for x in listed], "node string"), most).collect()}
    assert got == plain_terms(edges, listed, most)
    assert len({c for _, c, _ in got}) < len(got)


def test_terms_of_a_chain_and_none(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(9)], "parent string, child string")
    terms = spark.createDataFrame([("c9",), ("c8",), ("c4",), ("c3",), (None,), ("elsewhere",)], "node string")
    got = {(r.node, r.representative) for r in hierarchy.simplify_terms(chain, terms, 2).collect()}
    assert got == {("c9", "c8"), ("c8", "c8"), ("c4", "c3"), ("c3", "c3"), ("elsewhere", "elsewhere")}
    assert hierarchy.simplify_terms(chain, terms.where(F.lit(False)), 2).collect() == []


def test_models_are_tried_on_stratified_splits(spark):
    """Each round holds out a fifth of each label, anew; measures agree with predictions that are known."""
    from strandtable.operators import statistics

    rows = [(i, float(i % 10 > 6), float(i % 10), float(i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double")
    marked = statistics.stratified_splits(df, "y", "id", 4).collect()
    for k in range(4):
        assert [sum(r.tested[k] for r in marked if r.y == y) for y in (0.0, 1.0)] == [70, 30]
    assert len({tuple(r.id for r in marked if r.tested[k]) for k in range(4)}) == 4
    models = {k: m for k, m in statistics.classifiers().items() if k in ("tree", "naive_bayes")}
    got = {(r["model"], r["round"], r["part"]): r for r in statistics.model_eval_splits(df, ["a", "b"], "y", "id", models, 2).collect()}
    assert len(got) == 8 and all((r.n, r.mse, r.r2, r.accuracy, r.accuracy_0, r.accuracy_1) == ({"train": 400, "test": 100}[p], 0.0, 1.0, 1.0, 1.0, 1.0) for (m, _, p), r in got.items() if m == "tree")
    fit = statistics.model_eval_splits(df.withColumn("y", 2 * F.col("a") + 1), ["a"], "y", "id", {"linear": statistics.regressors()["linear"]}, 2, binary=False).collect()
    assert len(fit) == 4 and all(r.r2 == pytest.approx(1.0) and r.accuracy is None for r in fit) and sum(r.n for r in fit if r.part == "test") == 500


def test_closure_of_a_long_chain(spark):
    """More levels than are kept apart."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(34)], "parent int, child int")
    got = sorted((r.seed, r.node, r.depth) for r in hierarchy.closure(chain, spark.createDataFrame([(0,), (30,), (None,)], "node int")).collect())
    assert got == [(0, i, i) for i in range(35)] + [(30, i, i - 30) for i in range(30, 35)]
