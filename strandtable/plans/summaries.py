"""Queries of aggregations, windows, reshaping and matrix normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import matrix as N
from .registry import query, r6


@query("a1_count_by_chromosome", "SELECT chrom, count(*) AS n FROM annotation WHERE strand = '+' GROUP BY chrom", "annotation")
def _(v):
    return A.count_by_chromosome(v("annotation"), F.col("strand") == "+")


@query("a2_average_duplicates", "SELECT feature, sample, round(avg(value), 6) AS value FROM (SELECT feature, sample % 4 AS sample, value FROM counts WHERE sample < 6 UNION ALL SELECT feature, sample % 4, value FROM counts WHERE sample >= 6) WHERE feature IN (SELECT feature FROM counts WHERE sample < 6 INTERSECT SELECT feature FROM counts WHERE sample >= 6) GROUP BY 1, 2", "counts")
def _(v):
    c = v("counts")
    part = lambda w: c.where(w).withColumn("sample", F.col("sample") % 4)
    return A.average_duplicates([part("sample < 6"), part("sample >= 6")]).withColumn("value", r6("value"))


@query("a3_single_gene_probes", "SELECT l_orderkey AS probe, min(l_partkey) AS gene FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) = 1")
def _(v):
    return A.single_gene_probes(v("lineitem").select(F.col("l_orderkey").alias("probe"), F.col("l_partkey").alias("gene")))


@query("a4_collapse_probes", "SELECT p_brand AS gene, sample, round(avg(value), 6) AS value FROM counts JOIN part ON feature = p_partkey GROUP BY 1, 2", "counts")
def _(v):
    return A.collapse_probes(v("counts").withColumnRenamed("feature", "probe"), v("part").select(F.col("p_partkey").alias("probe"), F.col("p_brand").alias("gene"))).withColumn("value", r6("value"))


@query("a5_sample_detection", "SELECT sample, count(*) FILTER (WHERE value > 30) AS detected, sum(value) AS total FROM counts GROUP BY sample", "counts")
def _(v):
    return A.sample_detection(v("counts"), 30)


@query("a6_zero_frequency", "SELECT sample, round(1 - count(*) / (SELECT count(*) FROM part), 6) AS zero, round(count(*) / (SELECT count(*) FROM part), 6) AS nonzero FROM counts WHERE value <> 0 GROUP BY sample", "counts")
def _(v):
    z = A.zero_frequency(v("counts"), v("part").count())
    return z.select("sample", r6("zero").alias("zero"), r6("nonzero").alias("nonzero"))


@query("a6_zero_histogram", "SELECT condition, (SELECT count(*) FROM sheet z WHERE z.condition = k.condition) - k AS zeros, count(*) AS n FROM (SELECT condition, feature, count(DISTINCT sample) AS k FROM counts JOIN sheet USING (sample) GROUP BY 1, 2) k GROUP BY 1, 2", "counts sheet")
def _(v):
    return A.zero_histogram(v("counts"), v("sheet"))


@query("a7_contig_sizes", "SELECT source AS contig, sum(length(text)) AS length, '##contig=<ID=' || source || ',length=' || sum(length(text)) || '>' AS header FROM documents GROUP BY source")
def _(v):
    return A.contig_sizes(v("documents").select(F.col("source").alias("contig"), F.col("text").alias("seq")))


@query("a8_binned_mean", "SELECT s.chrom, b.bin, round(coalesce(m, 0), 6) AS mean FROM (SELECT chrom, max(pos // 50) AS last FROM points GROUP BY chrom) s, LATERAL (SELECT unnest(range(0, s.last + 1)) AS bin) b LEFT JOIN (SELECT chrom, pos // 50 AS bin, avg(value) AS m FROM points GROUP BY 1, 2) p ON p.chrom = s.chrom AND p.bin = b.bin", "points")
def _(v):
    return A.binned_mean(v("points"), ["chrom"], "pos", "value", 50).withColumn("mean", r6("mean"))


@query("a9_genome_offsets", "SELECT chrom, length, coalesce(sum(length) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset FROM (SELECT chrom, max(pos) AS length FROM points GROUP BY chrom)", "points")
def _(v):
    return A.genome_offsets(v("points").groupBy("chrom").agg(F.max("pos").alias("length")))


@query("a10_composition_rollup", "SELECT sample, clade AS genus, '' AS species, sum(value) AS abundance FROM profile GROUP BY 1, 2 UNION ALL SELECT sample, clade, species, value FROM profile WHERE species <> 'PROMO'", "profile")
def _(v):
    p = v("profile").select("sample", F.col("clade").alias("genus"), F.when(F.col("species") == "PROMO", "sp.").otherwise(F.col("species")).alias("species"), F.col("value").alias("abundance"))
    return A.composition_rollup(p)


@query("a11_group_junction_median", "SELECT condition, start, stop, median(reads) AS reads FROM junctions JOIN sheet USING (sample) GROUP BY 1, 2, 3", "junctions sheet")
def _(v):
    return A.group_junction_median(v("junctions"), v("sheet").select("sample", "condition"))


@query("a11_group_coverage_mean", "SELECT condition, pos, round(sum(value) / n, 6) AS coverage FROM points JOIN sheet USING (sample) JOIN (SELECT condition, count(*) AS n FROM sheet GROUP BY 1) USING (condition) GROUP BY condition, pos, n", "points sheet")
def _(v):
    return A.group_coverage_mean(v("points"), v("sheet").select("sample", "condition")).withColumn("coverage", r6("coverage"))


@query("a12_normalize_junctions", "SELECT sample, start, stop, round(reads * 1e6 / total, 6) AS norm_reads FROM junctions JOIN (SELECT sample, sum(reads) AS total FROM junctions GROUP BY 1) USING (sample)", "junctions")
def _(v):
    j = v("junctions")
    return A.normalize_junctions(j, j.groupBy("sample").agg(F.sum("reads").alias("total"))).select("sample", "start", "stop", r6("norm_reads").alias("norm_reads"))


@query("a13_condition_summary", "SELECT condition, count(value) AS n, round(avg(value), 6) AS mean, median(value) AS median, round(stddev_pop(value), 6) AS std FROM counts JOIN sheet USING (sample) GROUP BY 1", "counts sheet")
def _(v):
    s = A.condition_summary(v("counts").join(v("sheet"), "sample"))
    return s.withColumns({"mean": r6("mean"), "std": r6("std")})


@query("a14_methylation_ratio", "SELECT chrom, pos, sample, round(CASE WHEN meth + unmeth + 1 < 3 THEN 0 ELSE meth / (meth + unmeth + 1) END, 6) AS ratio FROM calls", "calls")
def _(v):
    return v("calls").select("chrom", "pos", "sample", r6(A.methylation_ratio(F.col("meth"), F.col("unmeth"), 3)).alias("ratio"))


@query("a15_hyper_hypo", "SELECT chrom, count(*) FILTER (WHERE d > 0) AS hyper, count(*) FILTER (WHERE d < 0) AS hypo FROM (SELECT chrom, pos, sum(meth - unmeth) AS d FROM calls GROUP BY 1, 2) WHERE abs(d) >= 2 GROUP BY 1", "calls")
def _(v):
    d = v("calls").groupBy("chrom", "pos").agg(F.sum(F.col("meth") - F.col("unmeth")).alias("difference")).withColumn("pvalue", F.lit(0.01))
    return A.hyper_hypo(d, 0.05, 2)


@query("a16_motif_hits", "SELECT l_shipdate_m AS motif, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_partkey END) AS experiment, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_partkey END) AS background FROM (SELECT *, l_suppkey AS l_shipdate_m FROM lineitem WHERE l_tax < 0.03) GROUP BY 1")
def _(v):
    h = v("lineitem").select(F.when(F.col("l_linestatus") == "F", "experiment").otherwise("background").alias("set"), F.col("l_suppkey").alias("motif"), F.col("l_partkey").alias("sequence"), F.col("l_orderkey").alias("start"), F.col("l_linenumber").alias("stop"), F.lit("+").alias("strand"), F.col("l_tax").alias("pvalue"))
    return A.motif_hits(h.where("pvalue < 0.03"), 0.03)


@query("a17_strandness", "SELECT round(eu / (eu + ef + es), 6) AS unstranded, round(ef / (eu + ef + es), 6) AS first, round(es / (eu + ef + es), 6) AS second, CASE WHEN eu / (eu + ef + es) > 0.9 THEN 'unstranded' WHEN ef / (eu + ef + es) > 0.9 THEN 'first' WHEN es / (eu + ef + es) > 0.9 THEN 'second' ELSE 'unclear' END AS call FROM (SELECT exp(10 * sum(l_quantity) / t) AS eu, exp(10 * sum(l_linenumber) / t) AS ef, exp(10 * sum(l_discount) / t) AS es FROM lineitem, (SELECT sum(l_quantity + l_linenumber + l_discount) AS t FROM lineitem) GROUP BY t)")
def _(v):
    c = v("lineitem").select(F.col("l_quantity").alias("unstranded"), F.col("l_linenumber").cast("double").alias("first"), F.col("l_discount").alias("second"))
    s = A.strandness(c)
    return s.select(*[r6(k).alias(k) for k in ("unstranded", "first", "second")], "call")


@query("a18_gene_set_sizes", "SELECT category, count(*) AS n FROM t2g GROUP BY category HAVING count(*) BETWEEN 5 AND 100000", "t2g")
def _(v):
    return A.gene_set_sizes(v("t2g"), 5, 100000)


_PEAKS = "SELECT l_partkey AS gene, concat(l_orderkey, ':', l_linenumber) AS peak_id, round(l_discount - 0.05, 4) AS fc, l_tax AS padj FROM lineitem"


def _peaks(v):
    return v("lineitem").select(F.col("l_partkey").alias("gene"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("peak_id"), F.round(F.col("l_discount") - 0.05, 4).alias("log2FoldChange"), F.col("l_tax").alias("padj"))


@query("a19_peak_gene_classes", f"SELECT gene, CASE WHEN count(*) = 1 THEN 'one_peak' WHEN count(*) FILTER (WHERE fc > 0) = count(*) OR count(*) FILTER (WHERE fc < 0) = count(*) THEN 'multi_concordant' ELSE 'multi_discordant' END AS class, count(*) AS n_peaks FROM ({_PEAKS}) WHERE padj < 0.01 GROUP BY gene")
def _(v):
    return A.peak_gene_classes(_peaks(v), 0.01)


@query("a20_vep_flatten", "SELECT event_id AS input, event_type AS gene, 'HIGH' AS impact, unnest([event_type, json_extract_string(props, '$.k')]) AS term FROM events")
def _(v):
    e = v("events").select(F.col("event_id").alias("input"), F.array(F.struct(F.col("event_type").alias("gene"), F.lit("HIGH").alias("impact"), F.array("event_type", F.get_json_object("props", "$.k")).alias("terms"))).alias("consequences"))
    return A.vep_flatten(e)


@query("a20_lowest_frequency", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) WHEN event_id % 3 = 1 THEN CAST(least(user_id, 7) AS VARCHAR) ELSE 'unknown' END AS frequency FROM events")
def _(v):
    m = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("amr"), F.col("user_id"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("eur"), F.col("user_id"), F.lit("afr"), F.lit(7).cast("long"))).otherwise(F.create_map().cast("map<string,bigint>"))
    return v("events").select("event_id", A.lowest_frequency(m).alias("frequency"))


@query("w1_running_average", "SELECT chrom, pos, sample, round(avg(value) OVER (PARTITION BY chrom, sample ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS running FROM (SELECT chrom, pos, sample, sum(value) AS value FROM points GROUP BY 1, 2, 3)", "points")
def _(v):
    p = v("points").groupBy("chrom", "pos", "sample").agg(F.sum("value").alias("value"))
    return A.running_average(p, ["chrom", "sample"], ["pos"], "value", 6).select("chrom", "pos", "sample", r6("running").alias("running"))


@query("w2_kneedle", "SELECT sample, i AS index, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(hi + (lo - hi) * i / n - v, 9) DESC, i) AS k FROM (SELECT sample, value AS v, row_number() OVER (PARTITION BY sample ORDER BY value DESC) - 1 AS i, max(value) OVER (PARTITION BY sample) AS hi, min(value) OVER (PARTITION BY sample) AS lo, count(*) OVER (PARTITION BY sample) AS n FROM counts)) WHERE k = 1", "counts")
def _(v):
    return A.kneedle(v("counts"), "value", ["sample"])


@query("w3_merge_intervals", "SELECT chrom, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start <= 1 + max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT chrom, start, stop FROM regions))) GROUP BY chrom, g", "regions")
def _(v):
    return A.merge_intervals(v("regions"))


@query("w4_exon_numbering", "SELECT gene, start, stop, strand, concat('E', row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN strand = '-' THEN -stop ELSE start END, start, stop)) AS exon FROM (SELECT biotype AS gene, start, stop, CASE WHEN biotype < 'Brand#3' THEN '-' ELSE '+' END AS strand FROM annotation)", "annotation")
def _(v):
    e = v("annotation").select(F.col("biotype").alias("gene"), "start", "stop", F.when(F.col("biotype") < "Brand#3", "-").otherwise("+").alias("strand"))
    return A.exon_numbering(e)


@query("w5_introns_from_exons", "SELECT gene, stop + 1 AS start, n - 1 AS stop FROM (SELECT biotype AS gene, stop, lead(start) OVER (PARTITION BY biotype ORDER BY start, stop) AS n FROM annotation) WHERE n > stop + 1", "annotation")
def _(v):
    return A.introns_from_exons(v("annotation").withColumnRenamed("biotype", "gene"))


@query("w6_top_n_genes", "SELECT gene_symbol FROM (SELECT gene_symbol, row_number() OVER (PARTITION BY log2FoldChange > 0 ORDER BY p, gene_symbol) AS k FROM (SELECT *, round(padj, 6) AS p FROM de WHERE log2FoldChange <> 0)) WHERE k <= 10", "de")
def _(v):
    return A.top_n_genes(v("de").withColumn("padj", r6("padj")), 10).select("gene_symbol")


@query("w7_best_peak_per_gene", f"""SELECT gene, CASE WHEN su + sd > 0 THEN t.p ELSE l.p END AS peak_id FROM (SELECT gene, count(*) FILTER (WHERE padj < 0.01 AND fc > 0) AS su, count(*) FILTER (WHERE padj < 0.01 AND fc < 0) AS sd, count(*) FILTER (WHERE fc > 0) AS u, count(*) FILTER (WHERE fc < 0) AS d,
max(CASE WHEN padj < 0.01 THEN {{'c': abs(fc), 'p': peak_id}} END) AS t, min({{'q': padj, 'p': peak_id}}) AS l FROM ({_PEAKS}) GROUP BY gene) WHERE CASE WHEN su + sd > 0 THEN su = 0 OR sd = 0 ELSE u = 0 OR d = 0 END""")
def _(v):
    return A.best_peak_per_gene(_peaks(v), 0.01).select("gene", "peak_id")


@query("w8_most_severe_effect", "SELECT user_id, arg_min(term, r) AS term FROM (SELECT user_id, event_type AS term, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END * 1000 + ascii(event_type) AS r FROM events) GROUP BY user_id")
def _(v):
    return A.most_severe_effect(v("events").select("user_id", F.col("event_type").alias("term")), ["user_id"], ["purchase", "click"])


@query("w9_top_k_matches", "SELECT query_id, tag_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, tag_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS tag_id, list_sum([CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]) / sqrt(list_sum([CAST(a.embedding[i] AS DOUBLE) ** 2 FOR i IN range(1, 65)]) * list_sum([CAST(b.embedding[i] AS DOUBLE) ** 2 FOR i IN range(1, 65)])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 3")
def _(v):
    from ..operators.vectors import cosine_matches

    e = v("embeddings")
    s = cosine_matches(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "tag_id"), k=3, digits=6)
    return A.top_k_matches(s.withColumn("similarity", r6("similarity"))).select("query_id", "tag_id", "rank")


@query("w10_top_categories", "SELECT category FROM (SELECT p_brand AS category, min(l_tax) AS padj FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE padj < 0.05 ORDER BY padj, category LIMIT 15")
def _(v):
    c = v("lineitem").join(v("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("category")).agg(F.min("l_tax").alias("padj"), F.max("l_quantity").alias("log2ratio"))
    return A.top_categories(c).select("category")


@query("w11_one_hot_code", "SELECT o_orderkey, concat(CAST(o_orderstatus = 'F' AS INT), CAST(o_totalprice > 100000 AS INT)) AS code FROM orders")
def _(v):
    o = v("orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 100000).alias("b"))
    return A.one_hot_code(o, ["a", "b"]).select("o_orderkey", "code").orderBy(F.desc("code"), "o_orderkey")


@query("w12_drop_ambiguous_names", "SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) = 1) UNION ALL SELECT l_orderkey, 'x' FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1")
def _(v):
    one = A.drop_ambiguous_names(v("part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "p_name")
    two = A.drop_ambiguous_names(v("lineitem").select("l_orderkey"), "l_orderkey").select("l_orderkey", F.lit("x"))
    return one.union(two)


@query("w13_balanced_splits", "SELECT CAST(turn // 40 AS INT) AS split, label, id FROM (SELECT id, label, unnest(range(k, 400, size)) AS turn FROM (SELECT doc_id AS id, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY md5('1:' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS size FROM labels))")
def _(v):
    return A.balanced_splits(v("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), 10, 40)


@query("w13_validation", """WITH r AS (SELECT doc_id AS id, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY md5('1:' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS size FROM labels), n AS (SELECT CAST(greatest(3, ceil(max(size) / 30)) AS INT) AS n FROM r),
s AS (SELECT CAST(unnest(range((SELECT n FROM n))) AS INT) AS split), p AS (SELECT split, CASE WHEN i < 30 THEN 'train' ELSE 'validation' END AS part, split * 30 + i AS place, i FROM (SELECT split, unnest(range(60)) AS i FROM s))
SELECT split, part, label, id FROM p, r WHERE place % size = k AND (i < 30 OR i < size)""")
def _(v):
    rows = v("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return A.balanced_splits(rows, 3, 30, validation=True, cover=True)


@query("r1_melt_pivot", "SELECT feature, CAST(s AS VARCHAR) AS sample, coalesce(sum(value) FILTER (WHERE sample = s), 0) AS value FROM counts, (SELECT unnest(range(12)) AS s) GROUP BY feature, s", "counts")
def _(v):
    return A.melt(A.pivot(v("counts"), list(range(12))), ["feature"], [str(s) for s in range(12)])


@query("r2_one_hot", "SELECT o_orderkey, o_orderstatus = 'F' AS s_F, o_orderstatus = 'O' AS s_O, o_orderstatus = 'P' AS s_P FROM orders")
def _(v):
    return A.one_hot(v("orders").select("o_orderkey", F.col("o_orderstatus").alias("s")), ["s"])


@query("r2_one_hot_cells", "SELECT o_orderkey AS key, 'p_' || o_orderpriority AS name FROM orders UNION ALL SELECT o_orderkey, 'c_' || o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 3) AND (SELECT sum(n) FILTER (WHERE n > 3) >= 0.75 * sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))")
def _(v):
    return A.one_hot_cells(v("orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("c")), "o_orderkey", ["p", "c"])


@query("r3_union_reports", "SELECT 'a' AS rule, count(*) AS n FROM orders UNION ALL SELECT 'b', count(*) FROM lineitem")
def _(v):
    n = F.count(F.lit(1)).alias("n")
    return A.union_reports([v("orders").agg(n).withColumn("rule", F.lit("a")), v("lineitem").agg(n).withColumn("rule", F.lit("b"))])


@query("r4_distinct_tags", "SELECT DISTINCT unnest(string_split(source || '; ' || lang, '; ')) AS tag FROM documents")
def _(v):
    return A.distinct_tags(v("documents").select(F.concat_ws("; ", "source", "lang").alias("tags")), "tags")


@query("r5_gene_universe", "SELECT gene_symbol FROM genes UNION SELECT gene_symbol FROM t2g", "genes t2g")
def _(v):
    return A.gene_universe(v("genes"), v("t2g"))


@query("r6_dedupe_exons", "SELECT chrom, start, id FROM (SELECT chrom, pos AS start, id, row_number() OVER (PARTITION BY chrom, pos ORDER BY id, qual) AS k FROM variants) WHERE k = 1", "variants")
def _(v):
    return A.dedupe_exons(v("variants").select("chrom", F.col("pos").alias("start"), "id", "qual"), ["chrom", "start"], "id").select("chrom", "start", "id")


_PF = "SELECT feature, sample, value * (SELECT median(t) FROM (SELECT sum(value) AS t FROM {0} GROUP BY sample)) / sum(value) OVER (PARTITION BY sample) AS value FROM {0}"
_SF = "full_ AS (SELECT f.feature, s.sample, CASE WHEN coalesce(value, 0) <= 0 THEN 1 ELSE value END AS value FROM (SELECT DISTINCT feature FROM counts) f CROSS JOIN (SELECT DISTINCT sample FROM counts) s LEFT JOIN counts c ON c.feature = f.feature AND c.sample = s.sample), sf AS (SELECT sample, median(value / exp(g)) AS size_factor FROM (SELECT sample, value, avg(ln(value)) OVER (PARTITION BY feature) AS g FROM full_) GROUP BY sample)"


def _value(df):
    return df.select("feature", "sample", r6("value").alias("value"))


@query("n1_pf_log1p_pf", f", one AS ({_PF.format('counts')}), two AS (SELECT feature, sample, ln(1 + value) AS value FROM one), three AS ({_PF.format('two')}) SELECT feature, sample, round(value, 6) AS value FROM three", "counts")
def _(v):
    return _value(N.pf_log1p_pf(v("counts")))


@query("n2_median_of_ratios", f", {_SF} SELECT feature, sample, round(value / size_factor, 6) AS value FROM counts JOIN sf USING (sample)", "counts")
def _(v):
    return _value(N.median_of_ratios(v("counts")))


@query("n3_cpm_log1p", "SELECT feature, sample, round(ln(1 + value * 1e6 / sum(value) OVER (PARTITION BY sample)), 6) AS value FROM counts", "counts")
def _(v):
    return _value(N.cpm_log1p(v("counts")))


@query("n4_tpm", "SELECT feature, sample, round(r * 1e6 / sum(r) OVER (PARTITION BY sample), 6) AS value FROM (SELECT feature, sample, value / greatest(coalesce(p_size, 1), 1) AS r FROM counts LEFT JOIN part ON feature = p_partkey)", "counts")
def _(v):
    return _value(N.tpm(v("counts"), v("part").select(F.col("p_partkey").alias("feature"), F.col("p_size").alias("length"))))


@query("n5_zscore_rows", "SELECT feature, sample, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, 6) + 0.0 AS value FROM (SELECT *, avg(value) OVER (PARTITION BY feature) AS m, stddev_samp(value) OVER (PARTITION BY feature) AS s FROM counts)", "counts")
def _(v):
    return _value(N.zscore_rows(v("counts")))


@query("n6_rescale_profile", "SELECT sample, clade, species, round(value * 100 / sum(value) OVER (PARTITION BY sample), 6) AS value FROM profile", "profile")
def _(v):
    return N.rescale_profile(v("profile"), percent=True).withColumn("value", r6("value"))


@query("n7_median_coverage_normalize", ", d AS (SELECT chrom, pos, sample, CAST(meth + unmeth AS DOUBLE) AS depth FROM calls), m AS (SELECT sample, median(depth) AS m FROM d GROUP BY sample) SELECT chrom, pos, sample, round(depth * (SELECT median(m) FROM m) / m, 6) AS depth FROM d JOIN m USING (sample)", "calls")
def _(v):
    d = v("calls").select("chrom", "pos", "sample", (F.col("meth") + F.col("unmeth")).cast("double").alias("depth"))
    return N.median_coverage_normalize(d, "depth").withColumn("depth", r6("depth"))


@query("n8_triwise_coords", "SELECT gene_symbol, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(atan2(y, x), 6) + 0.0 AS angle, round(sqrt(x * x + y * y), 6) AS radius FROM (SELECT gene_symbol, l1 - 0.5 * l2 - 0.5 * l3 AS x, sqrt(3) / 2 * (l2 - l3) AS y FROM (SELECT d.gene_symbol, pow(2, d.log2FoldChange) AS l1, pow(2, e.log2FoldChange) AS l2, pow(2, d.log2FoldChange - e.log2FoldChange) AS l3 FROM de d JOIN de2 e USING (gene_symbol) WHERE d.log2FoldChange <> 0 OR e.log2FoldChange <> 0))", "de de2")
def _(v):
    t = v("de").select("gene_symbol", F.col("log2FoldChange").alias("a")).join(v("de2").select("gene_symbol", F.col("log2FoldChange").alias("b")), "gene_symbol")
    return N.triwise_coords(t.withColumn("c", F.col("a") - F.col("b")), "a", "b", "c").select("gene_symbol", *[r6(c).alias(c) for c in ("x", "y", "angle", "radius")])


@query("n9_log_stabilize", f", {_SF} SELECT feature, sample, round(ln(value / size_factor + 1) / ln(2), 6) AS value FROM counts JOIN sf USING (sample)", "counts")
def _(v):
    return _value(N.log_stabilize(v("counts")))


@query("n10_batch_adjust", "SELECT feature, sample, round(greatest(exp(l - avg(l) OVER (PARTITION BY feature, batch) + avg(l) OVER (PARTITION BY feature)) - 1, 0), 6) AS value FROM (SELECT feature, sample, batch, ln(1 + value) AS l FROM counts JOIN sheet USING (sample))", "counts sheet")
def _(v):
    return _value(N.batch_adjust(v("counts"), v("sheet")))
