"""Queries of filters, joins and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, joins, vectors
from .registry import query, r6


@query("f1_vcf_filter", "SELECT chrom, pos, id, ref, alt FROM variants WHERE qual > 30 AND length(ref) = 1 AND length(alt) = 1 AND dp >= 20", "variants")
def _(v):
    return filters.vcf_filter(v("variants"), "QUAL > 30 && TYPE == SNP || DP >= 20").select("chrom", "pos", "id", "ref", "alt")


@query("f2_variant_type", "SELECT CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' WHEN length(ref) > length(alt) THEN 'indel' WHEN length(ref) < length(alt) THEN 'insert' ELSE 'NA' END AS type, count(*) AS n FROM variants GROUP BY 1", "variants")
def _(v):
    return v("variants").groupBy(filters.variant_type(F.col("ref"), F.col("alt")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("f3_spread_filter", "SELECT chrom, pos, id, round(qual, 6) AS qual FROM variants, (SELECT avg(qual) m, stddev_samp(qual) s, count(*) n FROM variants) WHERE n < 10 OR abs(qual - m) < 2 * s", "variants")
def _(v):
    return filters.spread_filter(v("variants"), "qual").select("chrom", "pos", "id", r6("qual").alias("qual"))


@query("f4_vcf_select", "SELECT pos, id, CAST(CAST(dp AS INT) AS VARCHAR) AS DP, 'NA' AS MQ, ref AS allele FROM variants", "variants")
def _(v):
    info = F.create_map(F.lit("DP"), F.col("dp").cast("int").cast("string"), F.lit("ANN"), F.concat(F.col("ref"), F.lit("|x|y")))
    return filters.vcf_select(v("variants").withColumn("info", info).drop("dp"), ["pos", "id", "DP", "MQ", "allele"], "info", {"allele": 0})


@query("f5_split_up_down", "SELECT gene_symbol, round(log2FoldChange, 6) + 0.0 AS fc, CASE WHEN log2FoldChange > 0 THEN 'up' ELSE 'down' END AS side FROM de WHERE padj < 0.2 AND abs(log2FoldChange) > 0.3", "de")
def _(v):
    up, down = filters.split_up_down(v("de"), 0.3, 0.2)
    part = lambda d, s: d.select("gene_symbol", r6("log2FoldChange").alias("fc"), F.lit(s).alias("side"))
    return part(up, "up").union(part(down, "down"))


@query("f6_classify_deg", "SELECT CASE WHEN padj < 0.2 AND log2FoldChange > 0.3 THEN 'Up' WHEN padj < 0.2 AND log2FoldChange < -0.3 THEN 'Down' ELSE 'NS' END AS regulation, count(*) AS n FROM de GROUP BY 1", "de")
def _(v):
    return filters.classify_deg(v("de"), 0.3, 0.2).groupBy("regulation").agg(F.count(F.lit(1)).alias("n"))


@query("f7_low_count_filter", "SELECT * FROM counts WHERE feature IN (SELECT feature FROM counts GROUP BY feature HAVING count(*) FILTER (WHERE value >= 40) >= 6)", "counts")
def _(v):
    return filters.low_count_filter(v("counts"), 40, 12)


@query("f8_drop_all_zero", "SELECT * FROM (SELECT feature, sample, CASE WHEN feature % 5 = 0 THEN 0 ELSE value END AS value FROM counts) WHERE feature % 5 <> 0 AND feature IN (SELECT feature FROM counts GROUP BY feature HAVING max(value) > 0)", "counts")
def _(v):
    return filters.drop_all_zero(v("counts").withColumn("value", F.when(F.col("feature") % 5 == 0, 0.0).otherwise(F.col("value"))))


@query("f9_zero_fraction_filter", "SELECT * FROM counts WHERE feature IN (SELECT feature FROM counts GROUP BY feature HAVING 1 - count(*) FILTER (WHERE value <> 0) / 12.0 <= 0.25)", "counts")
def _(v):
    return filters.zero_fraction_filter(v("counts"), 12)


@query("f10_coverage_percentile_filter", "SELECT chrom, pos, sample, meth + unmeth AS depth FROM calls JOIN (SELECT sample, quantile_cont(meth + unmeth, 0.999) AS top FROM calls GROUP BY sample) USING (sample) WHERE meth + unmeth >= 2 AND meth + unmeth <= top", "calls")
def _(v):
    return filters.coverage_percentile_filter(v("calls").select("chrom", "pos", "sample", (F.col("meth") + F.col("unmeth")).alias("depth")), "depth", 2)


@query("f11_tf_bound_genes", "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS gene FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_tax < 0.06 AND l_extendedprice >= (SELECT max(s_acctbal) FROM supplier) * 5)")
def _(v):
    sea = v("supplier").select(F.lit("M1").alias("alt_id"), (F.col("s_acctbal") * 5).alias("score_thr"))
    line = v("lineitem").withColumn("peak_id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    hits = line.where("l_linestatus = 'F'").select(F.lit("M1").alias("motif"), F.when(F.col("l_returnflag") == "R", "tp").otherwise("fp").alias("seq_class"), (F.col("l_tax") >= 0.06).alias("holdout"), F.col("l_extendedprice").alias("score"), "peak_id")
    return filters.tf_bound_genes(sea, hits, line.select("peak_id", F.col("l_partkey").cast("string").alias("gene")), "M1")


@query("f12_keyword_prefilter", r"WITH t AS (SELECT DISTINCT p_name AS term FROM part), w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(s_name || ' ' || 'hot item'), '[^\p{L}\p{N}]+')) AS word FROM supplier) SELECT term FROM t WHERE EXISTS (SELECT 1 FROM w WHERE word NOT IN ('', 'the') AND list_contains(regexp_split_to_array(lower(term), '[^\p{L}\p{N}]+'), word))")
def _(v):
    notes = v("supplier").select(F.concat_ws(" ", "s_name", F.lit("hot item")).alias("text"))
    return filters.keyword_prefilter(v("part").select(F.col("p_name").alias("term")).distinct(), notes, ["the"])


@query("f13_clip", "SELECT event_id, round(least(greatest(value, 10), 60), 6) AS value FROM events")
def _(v):
    return filters.clip(v("events").select("event_id", "value"), "value", 10.0, 60.0).withColumn("value", r6("value"))


@query("f14_normalize_column_names", "SELECT n_nationkey AS nation_key, n_name AS the_name FROM nation")
def _(v):
    return filters.normalize_column_names(v("nation").select(F.col("n_nationkey").alias("nation key"), F.col("n_name").alias("the name")))


@query("f15_regulation_labels", """SELECT * FROM (SELECT g.gene_symbol, CASE WHEN coalesce(a.padj, 1) >= 0.05 THEN 'Ns' WHEN a.log2FoldChange > 0 THEN 'Upreg' WHEN a.log2FoldChange < 0 THEN 'Downreg' ELSE 'Ns' END AS one,
CASE WHEN coalesce(b.padj, 1) >= 0.05 THEN 'Ns' WHEN b.log2FoldChange > 0 THEN 'Upreg' WHEN b.log2FoldChange < 0 THEN 'Downreg' ELSE 'Ns' END AS two
FROM genes g LEFT JOIN de a USING (gene_symbol) LEFT JOIN de2 b ON g.gene_symbol = b.gene_symbol) WHERE one <> 'Ns' OR two <> 'Ns'""", "genes de de2")
def _(v):
    return filters.regulation_labels(v("genes"), {"one": v("de"), "two": v("de2")})


@query("f16_resolve_gene_list", "SELECT DISTINCT a.gene_id, a.gene_name AS gene_symbol FROM annotation a WHERE a.gene_id IN (SELECT gene_symbol FROM genes)", "annotation genes")
def _(v):
    genes = v("genes").select(F.concat("gene_symbol", F.lit(".7")).alias("gene"))
    return filters.resolve_gene_list(genes, v("annotation").select("gene_id", F.col("gene_name").alias("gene_symbol")))


@query("f17_filter_gene_sets", "SELECT p_type AS category, p_brand AS subcategory, CAST(p_partkey AS VARCHAR) AS name FROM part WHERE (p_type = 'ECONOMY' OR p_brand = 'Brand#11' OR CAST(p_partkey AS VARCHAR) = '7') AND p_brand <> 'Brand#13'")
def _(v):
    sets = v("part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"), F.col("p_partkey").cast("string").alias("name"))
    return filters.filter_gene_sets(sets, ["ECONOMY", "Brand#11", "7"], ["Brand#13"])


@query("f18_peaks_of_interest", "SELECT gene_symbol, round(log2FoldChange, 6) + 0.0 AS fc FROM de2 WHERE padj < 0.3 AND gene_symbol IN (SELECT gene_symbol FROM genes)", "de2 genes")
def _(v):
    return filters.peaks_of_interest(v("de2"), v("genes"), 0.3).select("gene_symbol", r6("log2FoldChange").alias("fc"))


@query("j1_merge_results", "SELECT gene_symbol, round(coalesce(a.log2FoldChange, 0), 6) + 0.0 AS fa, round(coalesce(a.padj, 1), 6) AS pa, round(coalesce(b.log2FoldChange, 0), 6) + 0.0 AS fb, round(coalesce(b.padj, 1), 6) AS pb FROM (SELECT * FROM de WHERE padj < 0.5) a FULL JOIN (SELECT * FROM de2 WHERE padj < 0.5) b USING (gene_symbol)", "de de2")
def _(v):
    m = joins.merge_results({"a": v("de").where("padj < 0.5"), "b": v("de2").where("padj < 0.5")}, ["gene_symbol"])
    return m.select("gene_symbol", r6("log2FoldChange_a").alias("fa"), r6("padj_a").alias("pa"), r6("log2FoldChange_b").alias("fb"), r6("padj_b").alias("pb"))


@query("j2_annotate_matrix", "SELECT gene_id, gene_name, sample, value FROM annotation FULL JOIN (SELECT CAST(feature + 5 AS VARCHAR) AS gene_id, sample, value FROM counts) USING (gene_id)", "annotation counts")
def _(v):
    m = v("counts").select((F.col("feature") + 5).cast("string").alias("gene_id"), "sample", "value")
    return joins.annotate_matrix(m, v("annotation").select("gene_id", "gene_name"), "gene_id")


@query("j3_annotate_results", "SELECT gene_id, chrom, start, stop, round(fc, 6) + 0.0 AS fc FROM (SELECT gene_id, min(chrom) AS chrom, min(start) AS start, max(stop) AS stop FROM annotation GROUP BY gene_id) FULL JOIN (SELECT gene_symbol AS gene_id, log2FoldChange AS fc FROM de) USING (gene_id)", "annotation de")
def _(v):
    return joins.annotate_results(v("de"), v("annotation")).select("gene_id", "chrom", "start", "stop", r6("log2FoldChange").alias("fc"))


@query("j4_resolve_ids", "SELECT l_orderkey, l_linenumber, coalesce(p_name, 'Unknown') AS symbol FROM lineitem LEFT JOIN part ON l_partkey + 50 = p_partkey")
def _(v):
    rows = v("lineitem").select("l_orderkey", "l_linenumber", F.concat((F.col("l_partkey") + 50).cast("string"), F.lit(".2")).alias("gene"))
    return joins.resolve_ids(rows, v("part").select(F.col("p_partkey").cast("string").alias("gene_id"), F.col("p_name").alias("gene_symbol"))).drop("gene")


@query("j5_remove_control_variants", "SELECT chrom, pos, ref, alt, id FROM variants x WHERE sample < 8 AND NOT EXISTS (SELECT 1 FROM variants c WHERE c.sample >= 8 AND c.chrom = x.chrom AND c.pos = x.pos AND c.ref = x.ref AND c.alt = x.alt)", "variants")
def _(v):
    rows = v("variants")
    return joins.remove_control_variants(rows.where("sample < 8"), rows.where("sample >= 8")).select("chrom", "pos", "ref", "alt", "id")


_HGVS = "concat('chr', replace(chrom, 'chr', ''), ':g.', CASE WHEN length(ref) = length(alt) THEN CASE WHEN length(ref) = 1 OR substr(ref,1,1) <> substr(alt,1,1) OR ref = alt THEN concat(pos, substr(ref,1,1), '>', substr(alt,1,1)) ELSE concat(pos+1, substr(ref,2,1), '>', substr(alt,2,1)) END WHEN length(ref) < length(alt) THEN concat(pos, '_', pos+1, 'ins', substr(alt, 2)) WHEN length(ref) - length(alt) = 1 THEN concat(pos + length(alt), 'del') ELSE concat(pos + length(alt), '_', pos + length(ref) - 1, 'del') END)"


@query("g10_hgvs_genomic", f"SELECT pos, id, {_HGVS} AS hgvs FROM variants", "variants")
def _(v):
    return v("variants").select("pos", "id", joins.hgvs_genomic(*map(F.col, ("chrom", "pos", "ref", "alt"))).alias("hgvs"))


@query("j6_clinvar_annotate", f"SELECT pos, id, hgvs, coalesce(geneinfo, 'unknown') AS geneinfo, coalesce(clnsig, 'not_in_clinvar') AS clnsig FROM (SELECT *, {_HGVS} AS hgvs FROM variants) LEFT JOIN (SELECT {_HGVS} AS hgvs, string_agg(DISTINCT ref, ';' ORDER BY ref) AS geneinfo, string_agg(DISTINCT alt, ';' ORDER BY alt) AS clnsig FROM variants WHERE id < 4 GROUP BY 1) USING (hgvs)", "variants")
def _(v):
    known = v("variants").where("id < 4").select("chrom", "pos", "ref", "alt", F.col("ref").alias("geneinfo"), F.col("alt").alias("clnsig"), F.col("ref").alias("clndn"))
    return joins.clinvar_annotate(v("variants").select("chrom", "pos", "ref", "alt", "id"), known).select("pos", "id", "hgvs", "geneinfo", "clnsig")


@query("j7_filter_by_regions", "SELECT p.* FROM points p WHERE EXISTS (SELECT 1 FROM regions r WHERE r.chrom = p.chrom AND p.pos BETWEEN r.start AND r.stop)", "points regions")
def _(v):
    return joins.filter_by_regions(v("points"), v("regions"), 32)


@query("j8_region_counts", "SELECT region, sample, sum(value) AS value FROM regions r JOIN points p ON r.chrom = p.chrom AND p.pos BETWEEN r.start AND r.stop GROUP BY region, sample", "regions points")
def _(v):
    return joins.region_counts(v("points"), v("regions"), "value", 32)


@query("j9_annotate_overlaps", "SELECT r.region, a.biotype, count(*) AS n FROM regions r JOIN (SELECT CAST(p_size % 22 AS INT) AS chrom, p_brand AS biotype, CAST(p_partkey * 7 % 2500 AS INT) AS start, CAST(p_partkey * 7 % 2500 + p_size AS INT) AS stop FROM part) a ON r.chrom = a.chrom AND greatest(r.start - 10, 0) <= a.stop AND a.start <= r.stop + 10 GROUP BY 1, 2", "regions")
def _(v):
    a = v("part").select((F.col("p_size") % 22).cast("int").alias("chrom"), F.col("p_brand").alias("biotype"), (F.col("p_partkey") * 7 % 2500).cast("int").alias("start"), (F.col("p_partkey") * 7 % 2500 + F.col("p_size")).cast("int").alias("stop"))
    return joins.annotate_overlaps(v("regions"), a, 10, 64)


@query("j10_nearest_feature", "SELECT region, feature, distance FROM (SELECT r.region, a.feature, abs(a.pos - CAST(floor((r.start + r.stop) / 2) AS BIGINT)) AS distance, row_number() OVER (PARTITION BY r.region ORDER BY abs(a.pos - CAST(floor((r.start + r.stop) / 2) AS BIGINT)), a.pos, a.feature) AS k FROM regions r JOIN (SELECT CAST(p_size % 22 AS INT) AS chrom, p_partkey % 2500 AS pos, p_partkey AS feature FROM part) a ON r.chrom = a.chrom) WHERE k = 1", "regions")
def _(v):
    a = v("part").select((F.col("p_size") % 22).cast("int").alias("chrom"), (F.col("p_partkey") % 2500).alias("pos"), F.col("p_partkey").alias("feature"))
    return joins.nearest_feature(v("regions"), a)


@query("j11_merge_modalities", "SELECT gene_symbol, CASE WHEN pa < 0.05 AND pb < 0.01 THEN CASE WHEN sign(fa) = sign(fb) THEN 'Concordant' ELSE 'Discordant' END WHEN pa < 0.05 THEN 'RNA Only' WHEN pb < 0.01 THEN 'ATAC Only' ELSE 'NS' END AS label FROM (SELECT gene_symbol, coalesce(a.log2FoldChange, 0) fa, coalesce(a.padj, 1) pa, coalesce(b.log2FoldChange, 0) fb, coalesce(b.padj, 1) pb FROM (SELECT * FROM de WHERE padj < 0.9) a FULL JOIN de2 b USING (gene_symbol))", "de de2")
def _(v):
    return joins.merge_modalities(v("de").where("padj < 0.9"), v("de2"), ["gene_symbol"]).select("gene_symbol", "label")


@query("j12_paired_reads", "SELECT 1 AS mate, o_orderkey AS read_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 2, l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def _(v):
    one, two = joins.paired_reads(v("orders").select(F.col("o_orderkey").alias("read_id")), v("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("read_id")))
    return one.select(F.lit(1).alias("mate"), "read_id").union(two.select(F.lit(2).alias("mate"), "read_id"))


@query("j13_unite", "SELECT chrom, pos, sample FROM calls WHERE (chrom, pos) IN (SELECT (chrom, pos) FROM calls GROUP BY chrom, pos HAVING count(DISTINCT sample) = 2)", "calls")
def _(v):
    return joins.unite(v("calls"), ["chrom", "pos"], 2).select("chrom", "pos", "sample")


@query("j14_merge_coverage", "SELECT chrom, pos, " + ", ".join(f"coalesce(sum(meth) FILTER (WHERE sample = {s}), 0) AS s{s}" for s in range(4)) + " FROM calls GROUP BY chrom, pos", "calls")
def _(v):
    m = joins.merge_coverage(v("calls"), ["chrom", "pos"], "meth", [0, 1, 2, 3])
    return m.select("chrom", "pos", *[F.col(str(s)).alias(f"s{s}") for s in range(4)])


@query("j15_compare_junctions", "SELECT *, CASE WHEN reads_2 = 0 THEN 'group_1' WHEN reads_1 = 0 THEN 'group_2' ELSE 'both' END AS only FROM (SELECT start, stop, coalesce(sum(reads) FILTER (WHERE sample < 2), 0) AS reads_1, coalesce(sum(reads) FILTER (WHERE sample IN (2, 3)), 0) AS reads_2 FROM junctions GROUP BY start, stop) WHERE reads_1 >= 30 OR reads_2 >= 30", "junctions")
def _(v):
    j = v("junctions")
    sums = lambda c: j.where(c).groupBy("start", "stop").agg(F.sum("reads").alias("reads"))
    return joins.compare_junctions(sums("sample < 2"), sums("sample in (2, 3)"), ["start", "stop"], 30)


@query("j16_label_junction_exons", "SELECT j.start, j.stop, coalesce(l.x, '') AS left_exon, coalesce(r.x, '') AS right_exon FROM (SELECT DISTINCT start, stop FROM junctions) j LEFT JOIN (SELECT stop, string_agg(DISTINCT e, ',' ORDER BY e) x FROM (SELECT CAST(p_partkey % 500 AS INT) AS stop, concat('E', p_size) AS e FROM part) GROUP BY stop) l ON l.stop = j.start LEFT JOIN (SELECT start, string_agg(DISTINCT e, ',' ORDER BY e) x FROM (SELECT CAST(p_partkey % 500 AS INT) + 9 AS start, concat('E', p_size) AS e FROM part) GROUP BY start) r ON r.start = j.stop + 1", "junctions")
def _(v):
    end = (F.col("p_partkey") % 500).cast("int")
    exons = v("part").select(F.concat(F.lit("E"), F.col("p_size").cast("string")).alias("exon_id"), (end + 9).alias("start"), end.alias("stop"))
    return joins.label_junction_exons(v("junctions").select("start", "stop").distinct(), exons)


@query("j17_gene_intersection", "SELECT gene_symbol FROM de WHERE padj < 0.3 INTERSECT SELECT gene_symbol FROM de2 WHERE padj < 0.3", "de de2")
def _(v):
    return joins.gene_intersection(v("de"), v("de2"), 0.3)


@query("j18_sample_sheet_merge", "SELECT sample, n, total, condition FROM (SELECT sample, count(*) n FROM counts GROUP BY sample) JOIN (SELECT sample, sum(value) total FROM counts GROUP BY sample) USING (sample) JOIN sheet USING (sample)", "counts sheet")
def _(v):
    c = v("counts").groupBy("sample")
    return joins.sample_sheet_merge([c.agg(F.count(F.lit(1)).alias("n")), c.agg(F.sum("value").alias("total")), v("sheet")]).drop("batch")


_COS = "SELECT a.vec_id AS query_id, b.vec_id AS tag_id, list_sum([CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]) / sqrt(list_sum([CAST(a.embedding[i] AS DOUBLE) ** 2 FOR i IN range(1, 65)]) * list_sum([CAST(b.embedding[i] AS DOUBLE) ** 2 FOR i IN range(1, 65)])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"


@query("j19_cosine_pairs", f"SELECT query_id, tag_id, round(s, 6) + 0.0 AS similarity FROM ({_COS}) WHERE s >= 0.35")
def _(v):
    e = v("embeddings")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.cosine_matches(q, e.withColumnRenamed("vec_id", "tag_id"), 0.35).withColumn("similarity", r6("similarity"))


# Each vector, mixed with half of the next one, looks for the vectors that it is made of among all.
@query("j19_cosine_join", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT a.vec_id AS query_id, [a.v[i] + 0.5 * b.v[i] FOR i IN range(1, len(a.v) + 1)] AS v FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT query_id, vec_id AS tag_id, round(list_cosine_similarity(q.v, e.v), 6) + 0.0 AS similarity FROM q, e WHERE list_cosine_similarity(q.v, e.v) >= 0.75""")
def _(v):
    e = v("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    mixed = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next")), "vec_id").select(F.col("vec_id").alias("query_id"), F.zip_with("embedding", "_next", lambda a, b: a + 0.5 * b).alias("embedding"))
    return vectors.cosine_join(mixed, e.withColumnRenamed("vec_id", "tag_id"), 0.75, 0.9999)[0].withColumn("similarity", r6("similarity"))


@query("j20_map_names_to_ids", "SELECT d.gene_symbol AS name, p_name AS term_id FROM de d JOIN part ON CAST(p_partkey AS VARCHAR) = d.gene_symbol WHERE padj < 0.3", "de")
def _(v):
    terms = v("part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("term_id"))
    return joins.map_names_to_ids(v("de").withColumnRenamed("gene_symbol", "name"), terms, 0.3).select("name", "term_id")


@query("j21_map_or_keep", "SELECT o_orderkey, coalesce(c_name, CAST(o_custkey + 100 AS VARCHAR)) AS name, CASE WHEN c_name IS NULL THEN 'id' ELSE 'name' END AS origin FROM orders LEFT JOIN customer ON o_custkey + 100 = c_custkey")
def _(v):
    rows = v("orders").select("o_orderkey", (F.col("o_custkey") + 100).alias("id"))
    return joins.map_or_keep(rows, v("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id").drop("id")


@query("j22_align_samples", "SELECT feature, sample, value FROM counts WHERE sample IN (SELECT sample FROM sheet WHERE batch < 2)", "counts sheet")
def _(v):
    return joins.align_samples(v("counts"), v("sheet").where("batch < 2"))[0]
