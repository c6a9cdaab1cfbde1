"""Hand-worked results and properties of operators."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandtable.functions import numeric as N
from strandtable.functions.ranking import average_ranks
from strandtable.operators import aggregates, community, exploration, filters, hierarchy, joins, sequences, statistics
from strandtable.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x", [0.5, 1.0, 3.3, 40.0, 1e5])
def test_lgamma(spark, x):
    assert one(spark, N.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-12)


@pytest.mark.parametrize("x", [-2.0, 0.0, 0.3, 2.0, 6.0])
def test_erfc(spark, x):
    assert one(spark, N.erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=2e-7)


def test_hypergeometric_tails(spark):
    exact = lambda k: sum(math.comb(10, i) * math.comb(40, 12 - i) for i in range(k, 11)) / math.comb(50, 12)
    for k in (0, 1, 4, 10, 11):
        assert one(spark, N.hypergeometric_sf(F.lit(k), F.lit(50), F.lit(10), F.lit(12))) == pytest.approx(exact(k), abs=1e-10)


def test_t_and_chi2(spark):
    assert one(spark, N.t_two_sided(F.lit(2.228), F.lit(10))) == pytest.approx(0.05, abs=1e-4)
    assert one(spark, N.t_two_sided(F.lit(1.0), F.lit(1))) == pytest.approx(0.5, abs=1e-9)
    for df, x in ((1, 3.841), (2, 5.991), (5, 11.070)):
        assert one(spark, N.chi2_sf(F.lit(x), F.lit(df))) == pytest.approx(0.05, abs=1e-4)


def test_bh_is_monotone_and_worked(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.5)] + [(None,)], "pvalue double")
    got = {r.pvalue: r.padj for r in statistics.bh_fdr(df).collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.03] == pytest.approx(0.16 / 3) and got[0.04] == pytest.approx(0.16 / 3) and got[0.5] == 0.5 and got[None] is None


def test_pieces_rank_like_one_window(spark):
    rows = [(None if i % 7 == 0 else i % 3, float(i * 37 % 101) if i % 5 else 4.0) for i in range(400)] + [(1, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = sorted((str(r.k), r.v, r.r) for r in average_ranks(df, ["k"], "v", "r").collect())
    want = []
    for k, v in rows[:-1]:
        mine = [x for j, x in rows[:-1] if j == k]
        want.append((str(k), v, sum(x < v for x in mine) + (mine.count(v) + 1) / 2))
    assert got == sorted(want)
    assert average_ranks(df.where("false"), [], "v", "r").count() == 0


def test_mann_whitney_in_pieces(spark):
    df = spark.createDataFrame([(i % 2, float(i * i % 83), "ab"[i % 3 > 1]) for i in range(300)], "k int, v double, g string")
    whole, cut = (sorted(map(tuple, statistics.mann_whitney(df, ["k"], "v", "g", "a", few).collect())) for few in (False, True))
    assert whole == cut


def test_kruskal_wallis_worked(spark):
    rows = [("k", v, g) for g, vs in (("a", [27, 2, 4, 18, 7, 9]), ("b", [20, 8, 14, 36, 21, 22]), ("c", [34, 31, 3, 23, 30, 6])) for v in vs] + [("one", 1, "a")]
    got = {r.k: r for r in statistics.kruskal_wallis(spark.createDataFrame(rows, "k string, v int, g string"), ["k"], "v", "g").collect()}
    assert got["k"].h == pytest.approx(2.854, abs=1e-3) and got["k"].df == 2 and got["one"].h is None


def test_merge_intervals_across_pieces(spark):
    rows = [(i % 2, i * 17 % 3000, i * 17 % 3000 + (2500 if i == 40 else i % 11)) for i in range(900)]
    got = sorted((r.chrom, r.start, r.stop) for r in aggregates.merge_intervals(spark.createDataFrame(rows, "chrom int, start int, stop int")).collect())
    want = []
    for c, a, b in sorted(rows):
        if want and want[-1][0] == c and a <= want[-1][2] + 1:
            want[-1] = (c, want[-1][1], max(b, want[-1][2]))
        else:
            want.append((c, a, b))
    assert got == want


def test_batch_components_are_removed(spark):
    rng = np.random.default_rng(3)
    batch = np.arange(12) % 2
    x = rng.normal(size=(60, 12)) + np.outer(6 * rng.normal(size=60), batch)
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(12)], "feature int, sample int, value double")
    sheet = spark.createDataFrame([(j, int(batch[j])) for j in range(12)], "sample int, batch int")
    got = community.remove_batch_components(m, sheet).toPandas().pivot(index="feature", columns="sample", values="value").to_numpy()
    axis = np.linalg.svd(x - x.mean(axis=1, keepdims=True), full_matrices=False)[2][0]
    assert np.allclose(got, x - np.outer((x - x.mean(axis=1, keepdims=True)) @ axis, axis))
    same = community.remove_batch_components(m, sheet.withColumn("batch", F.lit(1)))
    assert same.count() == 720


def test_mann_whitney_u_sum(spark):
    rows = [("k", float(v), g) for g, vs in (("a", [1, 2, 2, 5]), ("b", [2, 3, 9])) for v in vs]
    df = spark.createDataFrame(rows, "k string, v double, g string")
    u = [statistics.mann_whitney(df, ["k"], "v", "g", first).first()["u"] for first in ("a", "b")]
    assert u == [3.0, 9.0] and sum(u) == 12


def test_overlap_join_is_the_filtered_cross_join(spark):
    a = [(i, i % 2, 7 * i % 50, 7 * i % 50 + i % 9) for i in range(40)]
    b = [(i, i % 2, 11 * i % 60, 11 * i % 60 + i % 13) for i in range(40)]
    da, db = spark.createDataFrame(a, "a int, chrom int, s1 int, e1 int"), spark.createDataFrame(b, "b int, chrom int, s2 int, e2 int")
    got = sorted((r.a, r.b) for r in joins.overlap_join(da, db, 5, ("s1", "e1"), ("s2", "e2")).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])


def test_vcf_filter_missing_and_unknown(spark):
    df = spark.createDataFrame([(1, "A", "G", 9.0), (2, "A", "GT", None), (3, "A", "G", 50.0)], "pos int, ref string, alt string, qual double")
    ids = lambda e, **k: [r.pos for r in filters.vcf_filter(df, e, **k).collect()]
    assert ids("QUAL > 5") == [1, 3] and ids("NOPE > 5") == [1, 2, 3] and ids("TYPE == insert || QUAL > 20", every=False) == [2, 3]


def test_vcf_filter_info_and_format_keys(spark):
    rows = [(1, {"DP": "30"}, [("s1", {"GT": "0/1", "AD": "3,40"})]), (2, {"DP": "5", "MQ": "60"}, [("s1", {"GT": "1/1", "AD": "50,2"})]), (3, {}, [("s1", {"GT": "0/1"})])]
    df = spark.createDataFrame(rows, "pos int, info map<string,string>, samples array<struct<sample:string,values:map<string,string>>>")
    ids = lambda e: [r.pos for r in filters.vcf_filter(df, e, "info", samples="samples").collect()]
    assert ids("DP >= 20") == [1] and ids("NOPE > 5") == [1, 2, 3] and ids("AD > 10") == [1] and ids("GT == 0/1") == [1, 3] and ids("MQ > 50") == [2]


def test_fasta_with_marks_in_descriptions(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 A>G change\nACGT\nAC\n>c2\r\nGG\r\n")
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("c1", "ACGTAC"), ("c2", "GG")]


def test_overdispersion_scales_the_deviance(spark):
    rows = [(1, 10, "a", 8, 2), (1, 10, "b", 2, 8), (1, 10, "c", 9, 1), (1, 10, "d", 9, 1), (1, 20, "a", 5, 5), (1, 20, "c", 10, 0)]
    groups = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "B"), ("d", "B")], "sample string, condition string")
    got = {r.pos: r for r in statistics.diff_methylation(spark.createDataFrame(rows, "chrom int, pos int, sample string, meth int, unmeth int"), groups, "A", "B").collect()}
    ll = lambda m, u: (m * math.log(m / (m + u)) if m else 0) + (u * math.log(u / (m + u)) if u else 0)
    phi = max(1.0, ((8 - 5) ** 2 / 2.5 + (2 - 5) ** 2 / 2.5 + 0) / 2)
    want = 2 * (ll(10, 10) + ll(18, 2) - ll(28, 12)) / phi
    assert phi > 3 and got[10].pvalue == pytest.approx(math.erfc(math.sqrt(want / 2)), abs=1e-6)
    assert got[20].pvalue == pytest.approx(math.erfc(math.sqrt(ll(5, 5) + ll(10, 0) - ll(15, 5))), abs=1e-6) and got[20].difference == 50


def test_preranked_gsea_ignores_genes_without_a_score(spark):
    rows = [(f"g{i:03d}", float(100 - i)) for i in range(200)] + [(f"n{i}", None) for i in range(50)]
    sets = [("top", f"g{i:03d}") for i in range(20)] + [("spread", f"g{i:03d}") for i in range(0, 200, 10)]
    got = {r.category: r for r in statistics.preranked_gsea(spark.createDataFrame(rows, "gene_symbol string, score double"), spark.createDataFrame(sets, "category string, gene_symbol string"), 5, 100, 40).collect()}
    assert got["top"].es == pytest.approx(1.0) and got["top"].pvalue < 0.1 and got["spread"].pvalue > got["top"].pvalue


def test_merge_intervals_emits_the_last(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 8), ("a", 10, 11), ("b", 1, 2)], "chrom string, start int, stop int")
    assert sorted(map(tuple, aggregates.merge_intervals(df).collect())) == [("a", 1, 8), ("a", 10, 11), ("b", 1, 2)]


def test_closure_with_cycle_and_idempotence(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "parent string, child string")
    got = {(r.node, r.depth) for r in hierarchy.closure(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    seeds = spark.createDataFrame([(n,) for n, _ in got], "node string")
    assert {r.node for r in hierarchy.closure(e, seeds).collect()} == {"a", "b", "c", "d"}


def test_anchor_identity_counts_equal_bases(spark):
    """49 bases with one mismatch are 48 of 49 alike, however many k-mers the mismatch spoils."""
    seq = "ACGTTGCAAGCTTAGGCTACCATGACTGGATCCAATTCGGTCAGATAAC"
    other = seq[:24] + ("A" if seq[24] != "A" else "C") + seq[25:]
    frame = lambda *rows: spark.createDataFrame(rows, "contig string, seq string")
    runs = sequences.kmer_anchors(frame(("q", seq)), frame(("s", "TT" + other)), 8, 2)
    r = runs.first()
    assert (r.offset, r.start, r.stop, r.matches, r.score, r.coverage) == (2, 0, 49, 48, 47.0, 1.0) and r.identity == pytest.approx(48 / 49)
    whole = sequences.anchor_alignment(runs, frame(("q", seq)), frame(("s", "TT" + other))).first()
    assert (whole.length, whole.coverage, whole.score) == (49, 100.0, 47.0) and whole.identity == pytest.approx(4800 / 49) and whole.normalised == 47.0


def test_reverse_complement(spark):
    assert one(spark, sequences.reverse_complement(F.lit("acgtn"))) == "NACGT"


def test_gapless_overlap(spark):
    df = spark.createDataFrame([(1, "xxxACGTACGT", "ACGTACGTyy")], "pair int, a string, b string")
    r = sequences.gapless_overlap(df, 5).first()
    assert (r.offset, r.score, r.start, r.stop) == (-3, 8, 3, 11)


def plain_tau(x, y):
    """tau-b by merge sort in plain Python."""
    def falls(v):
        if len(v) < 2:
            return 0, v
        (a, left), (b, right) = falls(v[: len(v) // 2]), falls(v[len(v) // 2 :])
        out, i, n = [], 0, a + b
        for r in right:
            while i < len(left) and left[i] <= r:
                out.append(left[i])
                i += 1
            n += len(left) - i
            out.append(r)
        return n, out + left[i:]

    n = len(x)
    tied = lambda v: sum(c * (c - 1) // 2 for c in Counter(v).values())
    pairs, tx, ty, txy = n * (n - 1) // 2, tied(x), tied(y), tied(list(zip(x, y, strict=True)))
    against = falls([b for _, b in sorted(zip(x, y, strict=True))])[0]
    return (pairs - tx - ty + txy - 2 * against) / math.sqrt((pairs - tx) * (pairs - ty))


def test_kendall_matches_definition(spark):
    rows = [(float(x), float(y)) for x, y in [(1, 3), (2, 1), (2, 2), (4, 5), (5, 5), (6, 4)]]
    s = [(a[0] - b[0]) * (a[1] - b[1]) for a, b in combinations(rows, 2)]
    tx, ty = sum(a[0] == b[0] for a, b in combinations(rows, 2)), sum(a[1] == b[1] for a, b in combinations(rows, 2))
    want = (sum(v > 0 for v in s) - sum(v < 0 for v in s)) / math.sqrt((15 - tx) * (15 - ty))
    assert exploration.kendall_tau(spark.createDataFrame([*rows, (None, 1.0)], "x double, y double"), "x", "y") == pytest.approx(want)
    assert plain_tau(*zip(*rows, strict=True)) == pytest.approx(want)
    assert exploration.kendall_tau(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y") is None


@pytest.mark.parametrize("kind", ["distinct", "hot"])
def test_kendall_is_exact_on_many_values(spark, kind):
    """100,000 distinct values; and columns of which one value holds a third of the rows, with ties of both kinds."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=100_000)
    y = x + rng.normal(size=100_000)
    if kind == "hot":
        x, y = np.round(x[:20_000], 1), np.round(y[:20_000], 2)
        x[:7000], y[5000:12_000] = 0.0, -0.0
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert exploration.kendall_tau(df, "x", "y") == pytest.approx(plain_tau(x.tolist(), y.tolist()), rel=1e-12)


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", "ACGT" * 50), ("c2", "A")], "contig string, seq string")
    readers.write_fasta_per_contig(df, str(tmp_path / "f"))
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "f") + "/*").collect())) == [("c1", "ACGT" * 50), ("c2", "A")]


def test_gtf_missing_attribute(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\nchr1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "G1"; gene_biotype "lnc";\n')
    r = readers.read_gtf(spark, str(tmp_path / "a.gtf")).first()
    assert (r.gene_id, r.gene_name, r.gene_biotype, r.start) == ("G1", "", "lnc", 1)


def test_reads_are_whole_texts(spark):
    from strandtable.plans import domains

    rows = spark.createDataFrame([(1, "ab" * 500_003)], "item_id long, text string")
    assert domains._reads(lambda name: rows).first()["seq"] == "ab" * 500_003
