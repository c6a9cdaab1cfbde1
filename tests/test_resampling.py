"""Permutations without a sort, and the tests that draw their null from them."""

import math
import struct
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandtable.functions.permute import permuted
from strandtable.functions.ranking import row_places
from strandtable.operators import statistics


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 1025])
def test_permuted_is_a_permutation_for_each_key(spark, n):
    df = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<long>")).alias("key")).select("key", "id", permuted(F.col("id"), n, F.col("key")).alias("at"))
    by = {}
    for r in df.collect():
        by.setdefault(r.key, []).append((r.id, r.at))
    assert all(sorted(a for _, a in v) == list(range(n)) for v in by.values())
    if n > 50:
        assert len({tuple(a for _, a in sorted(v)) for v in by.values()}) == 8


def test_permuted_places_are_even(spark):
    """Each number lands on each place equally often, and pairs of neighbours are torn apart."""
    n, keys = 11, 8000
    rows = spark.range(keys).select("id", permuted(F.lit(3), n, F.col("id")).alias("a"), permuted(F.lit(4), n, F.col("id")).alias("b")).collect()
    for counts in (np.bincount([r.a for r in rows], minlength=n), np.bincount([(r.b - r.a) % n for r in rows], minlength=n)[1:]):
        even = keys / len(counts)
        assert ((counts - even) ** 2 / even).sum() < 40


def test_row_places_with_ties_and_hot_keys(spark):
    rows = [("hot" if i % 3 else None, 5.0 if i % 2 else float(i), f"g{i:04d}") for i in range(600)]
    got = row_places(spark.createDataFrame(rows, "k string, v double, g string"), [F.col("v").desc(), F.col("g")], ["k"], "at").collect()
    for key in ("hot", None):
        mine = sorted([(-v, g) for k, v, g in rows if k == key])
        assert [(r.g, r.at) for r in sorted(got, key=lambda r: r.at) if r.k == key] == [(g, i) for i, (_, g) in enumerate(mine)]
    assert row_places(spark.createDataFrame([], "k string, v double"), [F.col("v")], ["k"], "at").collect() == []


# Preranked sets


def plain_es(w, at):
    at = np.sort(at)
    n, k = len(w), len(at)
    mine = w[at]
    up = np.cumsum(mine) / mine.sum() if mine.sum() else np.arange(1, k + 1) / k
    step = mine / mine.sum() if mine.sum() else np.full(k, 1 / k)
    miss = (at - np.arange(k)) / max(n - k, 1)
    hi, lo = (up - miss).max(), (up - step - miss).min()
    return hi if hi >= -lo else lo


def test_gsea_p_agrees_with_plain_shuffling(spark):
    """Scores, p within four standard errors of 20,000 plain shuffles, and nes; ties at 0 and genes without a score."""
    rng = np.random.default_rng(5)
    scores = np.round(rng.normal(size=600), 2)
    scores[200:420] = 0.0
    genes = [f"g{i:03d}" for i in range(600)]
    order = sorted(range(600), key=lambda i: (-scores[i], genes[i]))
    w = np.abs(scores[order])
    sets = {"top": order[:25], "half": order[:60:2], "bottom": order[-30:], "zero": [i for i in range(210, 230)]} | {f"any{j}": list(rng.choice(600, 20 + j, replace=False)) for j in range(4)}
    sets["leaning"] = order[:100:7] + order[300:310]
    ranks = spark.createDataFrame([(g, float(s)) for g, s in zip(genes, scores, strict=True)] + [("none", None)], "gene_symbol string, score double")
    t2g = spark.createDataFrame([(c, genes[i]) for c, some in sets.items() for i in some] + [("small", "g000"), ("top", "none")], "category string, gene_symbol string")
    got = {r.category: r for r in statistics.preranked_gsea(ranks, t2g, 10, 100, 500, most_rounds=5000).collect()}
    assert set(got) == set(sets)
    place = {g: p for p, g in enumerate(order)}
    for c, some in sets.items():
        es = plain_es(w, np.array([place[i] for i in some]))
        null = np.array([plain_es(w, rng.permutation(600)[: len(some)]) for _ in range(20_000 if c in ("leaning", "any0", "half") else 2000)])
        same = null[(null >= 0) == (es >= 0)]
        p = ((np.abs(same) >= abs(es)).sum() + 1) / (len(same) + 1)
        error = math.sqrt(p * (1 - p) * (2.2 / got[c].rounds + 1 / len(same))) + 2 / got[c].rounds
        assert got[c].es == pytest.approx(es) and got[c].nes == pytest.approx(es / np.abs(same).mean(), rel=0.1)
        assert abs(got[c].pvalue - p) < 4 * error, c
    assert got["top"].rounds == 5000 and got["top"].pvalue < 0.001 and got["any1"].rounds == 500


# Nested resampling


def spark_hash(*longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
    return h - 2**64 if h >= 2**63 else h


def welch(a, b):
    error = math.sqrt(np.var(a, ddof=1) / len(a) + np.var(b, ddof=1) / len(b))
    return (np.mean(b) - np.mean(a)) / error if error > 0 else None


def test_nested_test_by_brute_force(spark):
    """Three replicates against three: every deal of the treatments, and the drawn values one by one."""
    rng = np.random.default_rng(11)
    values = {f"r{i}": [float(x) for x in np.round(rng.normal(i // 3 * 0.8, 1, 9 + i), 3)] for i in range(6)}
    rows = [("ab"[int(k[1]) // 3], k, v) for k, some in values.items() for v in some] + [("a", "r0", None), ("c", "r9", 1.0)]
    got = statistics.nested_resampling_test(spark.createDataFrame(rows, "treatment string, replicate string, value double"), "a", "b", boots=7, seed=3).first()
    seen = welch(*([np.mean(values[f"r{i}"]) for i in some] for some in ((0, 1, 2), (3, 4, 5))))
    null = []
    for boot in range(1, 8):
        means = []
        for i, some in enumerate(values.values()):
            ranked, n = sorted(some), len(some)
            means.append(np.mean([ranked[spark_hash(3, boot, i, j) % n] for j in range(n)]))
        null += [welch([means[i] for i in first], [means[i] for i in range(6) if i not in first]) for first in combinations(range(6), 3)]
    assert got.t == pytest.approx(seen) and got.rounds == len(null) == 140
    assert got.pvalue == pytest.approx(np.mean([t is not None and abs(t) > abs(seen) for t in null]))


def test_nested_test_with_many_replicates_and_without_spread(spark):
    rows = [("a" if i < 9 else "b", i, float(i // 9 * 3 + (i * 7 + j) % 5)) for i in range(18) for j in range(4)]
    df = spark.createDataFrame(rows, "treatment string, replicate int, value double")
    r = statistics.nested_resampling_test(df, "a", "b", rounds=200, boots=5).first()
    assert r.rounds == 1000 and r.pvalue < 0.01 and r.t > 5
    flat = statistics.nested_resampling_test(df.withColumn("value", F.lit(1.0)), "a", "b", boots=2, rounds=10).first()
    assert flat.t is None and flat.pvalue == 0.0
