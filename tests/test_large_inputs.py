"""Operators that were wrong, or too slow or large, on larger tables, against plain code."""

import math
import statistics as plain
import threading
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandtable.operators import aggregates, hierarchy, joins, sequences, statistics, text, vectors


@contextmanager
def within(spark, seconds):
    """Jobs that still run after so many seconds are cancelled, which fails the test."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_bullet_lines_keep_their_digits_and_lose_their_spaces(spark):
    lines = ["0 is kept 0", "  1 and 1 ", " 2 or 2 ", " ", "\tfour 4\r"]
    rows = spark.createDataFrame([("\n".join(lines),), (None,)], "t string").select(F.explode(text.bullet_lines(F.col("t"))))
    assert [r[0] for r in rows.collect()] == ["0 is kept 0", "1 and 1", "2 or 2", "\tfour 4\r"]


TRACKS = [("a", 1, 3, 9, 2.0), ("a", 1, 3, 9, 2.0), ("a", 2, 5, 4200, 1.5), ("a", 3, 8, 8, None), ("a", 2, 4090, 4100, math.inf), ("a", 1, 8190, 8191, math.nan), ("b", 1, 0, 30, 4.0), ("b", 2, 9, 7, 3.0), (None, 1, 0, 9, 1.0)]
TRACK = "chrom string, sample int, from int, to int, value double"


def test_profile_of_starts_by_brute_force(spark):
    """Tracks over borders of tiles, twice, without value, not finite; genes of one name, of one start, without chromosome."""
    genes = [("g", "a", "+", 8, 90), ("g", "a", "-", 2, 6), ("h", "a", "-", 1, 6), ("i", "a", "+", 4095, 4099), ("j", "b", None, 1, 2), ("k", None, "+", 1, 2), ("l", "a", "+", 4300, 4301)]
    for tracks in (TRACKS, [t for t in TRACKS if t[4] is None], [t for t in TRACKS if t[0] != "a" or t[2] < 4000]):
        want = defaultdict(list)
        for _, chrom, strand, start, stop in genes:
            tss = stop if strand == "-" else start
            for c, _, lo, hi, value in tracks:
                if chrom is not None and c == chrom:
                    for pos in range(max(lo, tss - 5, 0), min(hi, tss + 5) + 1):
                        want[tss - pos if strand == "-" else pos - tss].append(value)
        many = len(genes) * len({t[1] for t in tracks})
        want = {k: sum(x for x in v if x is not None) / many if any(x is not None for x in v) else None for k, v in want.items()}
        got = {r.relative: r.value for r in sequences.tss_profile(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(genes, "gene string, chrom string, strand string, start int, stop int"), 5).collect()}
        assert got == {k: v if v is None else pytest.approx(v, rel=1e-12, nan_ok=True) for k, v in want.items()}


def test_median_of_bases_by_brute_force(spark):
    """Regions that overlap, of several pieces, and of one name on two chromosomes."""
    regions = [("r", "a", 0, 9), ("r", "a", 7, 12), ("s", "a", 5, 8), ("t", "a", 4098, 4099), ("t", "b", 4, 8), (None, "b", 4, 5), ("u", "a", 8, 8)]
    tracks = [t for t in TRACKS if not (t[4] is not None and math.isnan(t[4]))] + [("b", 1, 4100, 4110, 1.0)]
    groups = {1: "x", 2: "x", 3: "y"}
    for some in (regions, [r for r in regions if r[0] != "t"]):
        want = defaultdict(list)
        for name, chrom, start, stop in some:
            for c, sample, lo, hi, value in tracks:
                if c == chrom:
                    for pos in range(max(lo, start), min(hi, stop) + 1):
                        want[name, groups[sample], pos].append(value)
        want = {k: plain.median(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in want.items()}
        rows = sequences.region_coverage(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(some, "region string, chrom string, start int, stop int"), spark.createDataFrame(list(groups.items()), "sample int, condition string")).collect()
        assert {(r.region, r.condition, r.pos): r.value for r in rows} == want and len(rows) == len(want)


def test_profile_follows_places_not_pairs(spark):
    i = F.col("id")
    tracks = spark.range(60000).select(F.lit(1).alias("chrom"), F.lit(1).alias("sample"), (i % 2000).alias("from"), (i % 2000 + 500).alias("to"), F.lit(1.0).alias("value"))
    genes = spark.range(60000).select(i.alias("gene"), F.lit(1).alias("chrom"), F.lit("+").alias("strand"), (i % 2000 + 500).alias("start"), (i % 2000 + 501).alias("stop"))
    with within(spark, 60):
        got = {r.relative: r.value for r in sequences.tss_profile(tracks, genes, 20).collect()}
    assert len(got) == 41 and got[0] == 30 * (501 * 1500 + sum(range(1, 501))) / 2000


def test_medians_follow_bases_not_pairs(spark):
    i = F.col("id")
    tracks = spark.range(60000).select(F.lit(1).alias("chrom"), (i % 2).alias("sample"), (i % 2000).alias("from"), (i % 2000 + 500).alias("to"), (i % 5).cast("double").alias("value"))
    regions = spark.range(20000).select(i.alias("region"), F.lit(1).alias("chrom"), (i % 2000).alias("start"), (i % 2000 + 30).alias("stop"))
    with within(spark, 60):
        assert sequences.region_coverage(tracks, regions, spark.createDataFrame([(0, "x"), (1, "x")], "sample int, condition string")).agg(F.count("*"), F.countDistinct("pos")).first() == (20000 * 31, 2030)


def test_random_sets_over_blocks_agree_with_one_block(spark, monkeypatch):
    """Scores of random sets: their distribution over blocks of 64 places as over all, and as drawn plainly; sums over blocks are exact."""
    rng = np.random.default_rng(3)
    n, k, rounds = 300, 40, 3000
    weights = np.abs(np.sort(rng.normal(size=n))[::-1])

    def scores(size, w):
        monkeypatch.setattr(statistics, "PLACES", size)
        blocks = spark.createDataFrame([(b, [float(x) for x in w[b * size : (b + 1) * size]]) for b in range(math.ceil(n / size))], "block long, w array<double>")
        found = statistics._random_enrichment(blocks, n, spark.createDataFrame([(k,), (n,)], "k long"), 0, rounds, 7).collect()
        assert [r.es for r in found if r.k == n] == [pytest.approx(1.0)] * rounds
        return np.array([r.es for r in found if r.k == k])

    def plain_score(at):
        hit = np.isin(np.arange(n), at)
        run = np.cumsum(np.where(hit, weights / weights[at].sum(), -1 / (n - k)))
        hi, lo = max(run.max(), 0), min(run.min(), 0)
        return hi if hi >= -lo else lo

    want = np.array([plain_score(rng.choice(n, k, replace=False)) for _ in range(rounds)])
    for got in (scores(64, weights), scores(1 << 16, weights)):
        assert len(got) == rounds
        for q in (0.05, 0.25, 0.5, 0.75, 0.95):
            assert abs((got <= np.quantile(want, q)).mean() - q) < 0.05
    assert (scores(64, np.zeros(n)) != 0).all()


def test_random_sets_of_many_genes(spark):
    genes = spark.range(150000).select(F.col("id").cast("string").alias("gene_symbol"), (F.col("id") % 1001 - 500).cast("double").alias("score"))
    sets = spark.range(150000).select((F.col("id") % 3).cast("string").alias("category"), F.col("id").cast("string").alias("gene_symbol")).where("category <> '2' or id % 5 = 0").drop("id")
    with within(spark, 90):
        got = {r.category: r for r in statistics.preranked_gsea(genes, sets, 10, 100000, 200, most_rounds=200).collect()}
    assert {c: (r.k, r.rounds) for c, r in got.items()} == {"0": (50000, 200), "1": (50000, 200), "2": (10000, 200)} and all(0 < r.pvalue <= 1 for r in got.values())


def plain_ancestors(edges, node):
    depth, front = {node: 0}, [node]
    while front:
        front = [p for n in front for p, c in edges if c == n and p not in depth and not depth.update({p: depth[n] + 1})]
    return depth


def test_common_ancestors_by_brute_force(spark):
    """A graph with several parents, a cycle, listed terms above each other, a term alone and one that no edge has."""
    edges = [("r", "p"), ("r", "q"), ("p", "x"), ("p", "y"), ("q", "y"), ("q", "z"), ("x", "u"), ("x", "v"), ("z", "w"), ("c", "d"), ("d", "c"), ("d", "e"), ("s", "w")]
    terms = ["u", "v", "x", "y", "z", "w", "p", "r", "c", "d", "e", "alone"]
    frame = spark.createDataFrame([*edges, edges[0]], "parent string, child string")

    def plain_pair(a, b):
        one, two = plain_ancestors(edges, a), plain_ancestors(edges, b)
        return min(((one[n] + two[n] + 1, n) for n in one if n in two), default=(-1, ""))[::-1]

    pairs = [(a, b) for a in terms for b in terms]
    got = {(r.a, r.b): (r.ancestor, r.distance) for r in hierarchy.closest_common_ancestor(frame, spark.createDataFrame([*pairs, pairs[1]], "a string, b string")).collect()}
    assert got == {p: plain_pair(*p) for p in pairs}
    rows = hierarchy.closest_common_ancestors(frame, spark.createDataFrame([(t,) for t in [*terms, "u", None]], "node string")).collect()
    assert len(rows) == math.comb(len(terms), 2) and {(r.a, r.b): (r.ancestor, r.distance) for r in rows} == {(a, b): plain_pair(a, b) for a, b in pairs if a < b}


def test_common_ancestors_of_all_pairs_of_many_terms(spark):
    edges = spark.range(9000).select(F.concat(F.lit("p"), F.col("id") % 20).alias("parent"), F.concat(F.lit("t"), F.col("id")).alias("child"))
    edges = edges.union(spark.range(20).select(F.lit("root"), F.concat(F.lit("p"), F.col("id"))))
    with within(spark, 45):
        rows = hierarchy.closest_common_ancestors(edges, edges.where("child like 't%'").select(F.col("child").alias("node")))
        got = {(r.ancestor == "root", r.distance): r["count"] for r in rows.groupBy("ancestor", "distance").count().groupBy(F.when(F.col("ancestor") == "root", "root").otherwise("p").alias("ancestor"), "distance").agg(F.sum("count").alias("count")).collect()}
    assert got == {(False, 3): 20 * math.comb(450, 2), (True, 5): math.comb(9000, 2) - 20 * math.comb(450, 2)}


def test_likelihood_ratio_of_many_features(spark):
    """Features that repeat in turn have equal results; as many as expressions on arrays took minutes for."""
    base = np.random.default_rng(4).negative_binomial(3, 0.1, size=(50, 12))
    cells = spark.createDataFrame([(i, j, float(base[i, j])) for i in range(50) for j in range(12)], "kind int, sample int, value double")
    m = spark.range(30000).withColumn("kind", (F.col("id") % 50).cast("int")).join(cells, "kind").select(F.col("id").alias("feature"), "sample", "value")
    sheet = spark.createDataFrame([(j, "ab"[j % 2]) for j in range(12)], "sample int, condition string")
    with within(spark, 60):
        rows = statistics.nb_likelihood_ratio(m, sheet, ["a", "b"]).collect()
    few = {r.feature: r for r in statistics.nb_likelihood_ratio(cells.withColumnRenamed("kind", "feature"), sheet, ["a", "b"]).collect()}
    assert len(rows) == 30000 and all(r.lrt == pytest.approx(few[r.feature % 50].lrt, abs=1e-9) and r.dispersion == pytest.approx(few[r.feature % 50].dispersion) for r in rows)


def test_cosine_matches_by_brute_force(spark, monkeypatch):
    """Pairs at a limit and the best of each query, over many blocks: copies, ties, zero and null vectors, unlike lengths, NaN, keys as text."""
    monkeypatch.setattr(vectors, "SIDE", 40)
    rng = np.random.default_rng(8)
    rows = [(f"v{i:03d}", [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(200)] + [("null", None), ("zero", [0.0] * 6), ("short", [1.0, 2.0]), ("brief", [1.0, 2.5])]
    rows += [(f"copy{i}", rows[3][1]) for i in range(9)] + [("nan", [math.nan] * 6)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    q, t = df.where("id not like 'v1%'").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "tag_id")

    def plain_pairs(a, va):
        for b, vb in rows:
            if va and vb and len(va) == len(vb) and any(va) and any(vb):
                yield sum(x * y for x, y in zip(va, vb, strict=True)) / (math.sqrt(sum(x * x for x in va)) * math.sqrt(sum(x * x for x in vb))), b

    want = {a: list(plain_pairs(a, va)) for a, va in rows if not a.startswith("v1")}
    got = [(r.query_id, r.tag_id, str(r.similarity)) for r in vectors.cosine_matches(q, t, 0.5).collect()]
    assert sorted(got) == sorted((a, b, str(s)) for a, some in want.items() for s, b in some if not s < 0.5)
    best = aggregates.top_k_matches(vectors.cosine_matches(q, t, k=3).withColumn("similarity", F.round("similarity", 6)))
    rank = lambda p: (-math.inf if math.isnan(p[0]) else -round(p[0], 6), p[1])
    assert sorted((r.query_id, r["rank"], r.tag_id) for r in best.collect()) == sorted((a, i + 1, b) for a, some in want.items() for i, (_, b) in enumerate(sorted(some, key=rank)[:3]))


def test_cosine_matches_of_many_vectors(spark):
    tags = spark.range(60000).select(F.col("id").alias("tag_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.xxhash64("id", i) % 1000).cast("float")).alias("embedding"))
    with within(spark, 60):
        found = vectors.cosine_matches(tags.where("tag_id % 5 = 0").withColumnRenamed("tag_id", "query_id"), tags, 0.9).collect()
    assert sorted((r.query_id, r.tag_id) for r in found) == [(i, i) for i in range(0, 60000, 5)]


def test_nearest_feature_of_equal_middles(spark):
    """Many regions share a middle, some have no name or lie on a chromosome without features."""
    rng = np.random.default_rng(6)
    features = [(int(c), int(p), f"f{i}") for i, (c, p) in enumerate(zip(rng.integers(0, 2, 30), rng.integers(0, 300, 30), strict=True))]
    regions = [(i if i % 9 else None, i % 3, int(p), int(p) + i % 4) for i, p in enumerate(rng.integers(0, 320, 400))]
    want = []
    for name, chrom, start, stop in regions:
        at = [(abs(p - (start + stop) // 2), p, f) for c, p, f in features if c == chrom]
        if at:
            want.append((str(name), min(at)[2], min(at)[0]))
    got = joins.nearest_feature(spark.createDataFrame(regions, "region int, chrom int, start int, stop int"), spark.createDataFrame(features, "chrom int, pos int, feature string"), 8).collect()
    assert sorted((str(r.region), r.feature, r.distance) for r in got) == sorted(want)


def test_overlaps_by_brute_force(spark):
    """Spans over several tiles, of one name, without name or chromosome, and spans that stop before they start."""
    rng = np.random.default_rng(9)

    def spans(n, most, names, odd):
        for i, (start, long) in enumerate(zip(rng.integers(0, 200, n), rng.integers(0, most, n), strict=True)):
            yield names[i % len(names)], (0, 1, None)[i % 3 if i % 4 == 0 else i % 2], int(start), int(start + long - (odd and i % 7 == 0) * 2 * long)

    for odd in (False, True):
        regions = list(spans(150, 90, [*range(149), None] if not odd else [*range(60), None], odd))
        rows = list(spans(200, 120, ["a", "b", "c", None], odd))
        want = defaultdict(int)
        for name, c, start, stop in regions:
            for kind, d, first, last in rows:
                if c is not None and c == d and max(start - 4, 0) <= last and first <= stop + 4:
                    want[name, kind] += 1
        got = joins.annotate_overlaps(spark.createDataFrame(regions, "region int, chrom int, start int, stop int"), spark.createDataFrame(rows, "biotype string, chrom int, start int, stop int"), 4, 16).collect()
        assert {(r.region, r.biotype): r.n for r in got} == dict(want) and len(got) == len(want)


def test_overlaps_are_counted_not_made(spark):
    i = F.col("id")
    regions = spark.range(300000).select(i.alias("region"), F.lit(1).alias("chrom"), (i % 2000).alias("start"), (i % 2000 + 20).alias("stop"))
    rows = spark.range(300000).select(F.lit(1).alias("chrom"), (i % 3).alias("biotype"), (i % 2000).alias("start"), (i % 2000 + 30).alias("stop"))
    with within(spark, 60):
        found = joins.annotate_overlaps(regions, rows, 10, 64).agg(F.count("*"), F.sum("n"), F.max("n")).first()
    assert found[0] == 900000 and found[2] == 71 * 50 and found[1] == 150 * 150 * sum(min(s + 30, 1999) - max(s - 40, 0) + 1 for s in range(2000))
