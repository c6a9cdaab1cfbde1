"""Joins of results, matrices, annotation and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import settle


def merge_results(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """All rows of all tables by key: one union and one grouping; padj fills with 1, fold change with 0."""
    rows = reduce(DataFrame.unionByName, [t.select(*keys, "log2FoldChange", "padj", F.lit(n).alias("_t")) for n, t in tables.items()])
    at = lambda n, c, fill: F.coalesce(F.max(F.when(F.col("_t") == n, F.col(c))), F.lit(fill)).alias(f"{c}_{n}")
    return rows.groupBy(*keys).agg(*[x for n in tables for x in (at(n, "log2FoldChange", 0.0), at(n, "padj", 1.0))])


def annotate_matrix(matrix: DataFrame, annotation: DataFrame, key: str) -> DataFrame:
    return annotation.join(matrix, key, "full_outer")


def annotate_results(results: DataFrame, annotation: DataFrame, by: str = "gene_id") -> DataFrame:
    """The span of each feature (least start, greatest stop), joined fully with the results."""
    span = annotation.groupBy(by).agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return span.join(results.withColumnRenamed("gene_symbol", by) if by not in results.columns else results, by, "full_outer")


def resolve_ids(df: DataFrame, genes: DataFrame, column: str = "gene") -> DataFrame:
    """Add ``symbol``: the gene of an id (version ignored), else of a symbol, else ``Unknown``; the first name wins."""
    bare = F.substring_index(column, ".", 1)
    by_id = genes.groupBy(F.col("gene_id").alias("_i")).agg(F.min("gene_symbol").alias("_s1"))
    by_symbol = genes.select(F.col("gene_symbol").alias("_s2")).distinct()
    out = df.join(by_id, bare == F.col("_i"), "left").join(by_symbol, bare == F.col("_s2"), "left")
    return out.withColumn("symbol", F.coalesce("_s1", "_s2", F.lit("Unknown"))).drop("_i", "_s1", "_s2")


def remove_control_variants(sample: DataFrame, controls: DataFrame) -> DataFrame:
    keys = ["chrom", "pos", "ref", "alt"]
    return sample.join(controls.select(*keys).distinct(), keys, "left_anti")


def hgvs_genomic(chrom: Column, pos: Column, ref: Column, alt: Column, prefix: str = "chr") -> Column:
    """Substitution, insertion or deletion; equal longer alleles give their first differing base."""
    a, b = F.length(ref), F.length(alt)
    at = F.concat(F.lit(prefix), F.regexp_replace(chrom.cast("string"), "^chr", ""), F.lit(":g."))
    differ = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(a, F.lit(1))), lambda i: F.substring(ref, i, F.lit(1)) != F.substring(alt, i, F.lit(1))))
    k = F.coalesce(differ, F.lit(1))
    sub = F.concat(at, (pos + k - 1).cast("string"), F.substring(ref, k, F.lit(1)), F.lit(">"), F.substring(alt, k, F.lit(1)))
    ins = F.concat(at, pos.cast("string"), F.lit("_"), (pos + 1).cast("string"), F.lit("ins"), F.substring(alt, F.lit(2), b))
    one, span = (pos + b).cast("string"), F.concat((pos + b).cast("string"), F.lit("_"), (pos + a - 1).cast("string"))
    gone = F.concat(at, F.when(a - b == 1, one).otherwise(span), F.lit("del"))
    return F.when(a == b, sub).when(a < b, ins).otherwise(gone)


def clinvar_annotate(target: DataFrame, clinvar: DataFrame) -> DataFrame:
    """Left join on HGVS after alternatives are split; values are joined by ``;``."""
    rows = target.withColumn("alt", F.explode(F.split("alt", ","))).withColumn("hgvs", hgvs_genomic(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    known = clinvar.withColumn("alt", F.explode(F.split("alt", ","))).withColumn("hgvs", hgvs_genomic(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";").alias(c)
    known = known.groupBy("hgvs").agg(joined("geneinfo"), joined("clnsig"), joined("clndn"))
    return rows.join(known, "hgvs", "left").fillna("unknown", ["geneinfo", "clndn"]).fillna("not_in_clinvar", ["clnsig"])


CONCORDANCE = ("RNA", "ATAC")


def merge_modalities(rna: DataFrame, atac: DataFrame, keys: list[str], p_rna: float = 0.05, p_atac: float = 0.01) -> DataFrame:
    """Full outer join with fills (fold change 0, padj 1) and a five-way label."""
    part = lambda d, s: d.select(*keys, F.col("log2FoldChange").alias(f"fc_{s}"), F.col("padj").alias(f"padj_{s}"))
    both = part(rna, "rna").join(part(atac, "atac"), keys, "full_outer").fillna(0.0, ["fc_rna", "fc_atac"]).fillna(1.0, ["padj_rna", "padj_atac"])
    r, a = F.col("padj_rna") < p_rna, F.col("padj_atac") < p_atac
    label = F.when(r & a, F.when(F.signum("fc_rna") == F.signum("fc_atac"), "Concordant").otherwise("Discordant")).when(r, "RNA Only").when(a, "ATAC Only").otherwise("NS")
    return both.withColumn("label", label)


def paired_reads(first: DataFrame, second: DataFrame, key: str = "read_id") -> tuple[DataFrame, DataFrame]:
    """Rows of ids that both mates have."""
    return first.join(second.select(key), key, "left_semi"), second.join(first.select(key), key, "left_semi")


def unite(df: DataFrame, locus: list[str], samples: int) -> DataFrame:
    """Rows of loci that all samples have."""
    good = df.groupBy(*locus).agg(F.countDistinct("sample").alias("_n")).where(F.col("_n") == samples).drop("_n")
    return df.join(good, locus, "left_semi")


def merge_coverage(df: DataFrame, locus: list[str], value: str, samples: list) -> DataFrame:
    """One column per sample, missing as 0."""
    return df.groupBy(*locus).pivot("sample", samples).agg(F.sum(value)).fillna(0, [str(s) for s in samples])


def compare_junctions(one: DataFrame, two: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Full outer join of two groups with 0 for missing; rows under ``least`` in both go; flags what one group has alone."""
    both = one.select(*keys, F.col("reads").alias("reads_1")).join(two.select(*keys, F.col("reads").alias("reads_2")), keys, "full_outer").fillna(0.0, ["reads_1", "reads_2"])
    both = both.where((F.col("reads_1") >= least) | (F.col("reads_2") >= least))
    return both.withColumn("only", F.when(F.col("reads_2") == 0, "group_1").when(F.col("reads_1") == 0, "group_2").otherwise("both"))


def label_junction_exons(junctions: DataFrame, exons: DataFrame) -> DataFrame:
    """Ids of exons that end at a junction's start and that start after its stop, comma-joined."""
    names = lambda key, out: exons.groupBy(F.col(key).alias("_k")).agg(F.array_join(F.array_sort(F.collect_set("exon_id")), ",").alias(out))
    left, right = names("stop", "left_exon"), names("start", "right_exon")
    out = junctions.join(left, F.col("start") == F.col("_k"), "left").drop("_k")
    return out.join(right, F.col("stop") + 1 == F.col("_k"), "left").drop("_k").fillna("", ["left_exon", "right_exon"])


def gene_intersection(transcripts: DataFrame, exons: DataFrame, p_limit: float = 0.05) -> DataFrame:
    """Genes significant in both tables (gene_symbol, padj)."""
    hit = lambda d: d.where(F.col("padj") < p_limit).select("gene_symbol")
    return hit(transcripts).intersect(hit(exons))


def sample_sheet_merge(tables: list[DataFrame], key: str = "sample") -> DataFrame:
    return reduce(lambda a, b: a.join(b, key), tables)


def cosine_pairs(queries: DataFrame, tags: DataFrame, limit: float | None = None) -> DataFrame:
    """(query_id, tag_id, similarity) of a stated query set against all tags; every pair.

    Vectors are normalised once. The smaller, stated side is broadcast only if the optimizer's size limit
    allows it; otherwise Spark deals the pairs out in blocks. Where few pairs are wanted, ``vectors.cosine_matches`` makes no others.
    """
    def unit(df: DataFrame, key: str, out: str) -> DataFrame:
        v = F.transform("embedding", lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return df.select(F.col(key), v.alias(out), norm.alias(f"{out}_n")).where(F.col(f"{out}_n") > 0)

    pairs = unit(queries, "query_id", "q").crossJoin(unit(tags, "tag_id", "t"))
    dot = F.aggregate(F.zip_with("q", "t", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    out = pairs.select("query_id", "tag_id", (dot / (F.col("q_n") * F.col("t_n"))).alias("similarity"))
    return out if limit is None else out.where(F.col("similarity") >= limit)


def map_names_to_ids(results: DataFrame, terms: DataFrame, p_limit: float = 0.05) -> DataFrame:
    return results.where(F.col("padj") < p_limit).join(terms.select("name", "term_id"), "name")


def map_or_keep(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Add ``name`` and its ``origin``: mapped, or the id itself."""
    out = rows.join(names.select(key, F.col("name").alias("_name")), key, "left")
    return out.withColumn("name", F.coalesce("_name", F.col(key).cast("string"))).withColumn("origin", F.when(F.col("_name").isNull(), "id").otherwise("name")).drop("_name")


def align_samples(matrix: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to the samples that they share."""
    return matrix.join(sheet.select("sample").distinct(), "sample", "left_semi"), sheet.join(matrix.select("sample").distinct(), "sample", "left_semi")


# Intervals

#: Bases within which running sums over a chromosome start anew.
TILE = 4096


def overlap_join(a: DataFrame, b: DataFrame, width: int, ends_a: tuple[str, str] = ("start", "stop"), ends_b: tuple[str, str] = ("start", "stop")) -> DataFrame:
    """Pairs of rows of one ``chrom`` whose closed intervals overlap, each pair once.

    Both sides are spread over bins of ``width``, an equi join on (chrom, bin) finds candidates, and a pair
    counts in the bin where the later of its starts lies, so nothing needs to be made distinct. Column
    names but ``chrom`` must differ.
    """
    spread = lambda d, e: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(e[0]) / width), F.floor(F.col(e[1]) / width))))
    both = spread(a, ends_a).join(spread(b, ends_b), ["chrom", "_bin"])
    (s1, e1), (s2, e2) = ends_a, ends_b
    both = both.where((F.col(s1) <= F.col(e2)) & (F.col(s2) <= F.col(e1)) & (F.col("_bin") == F.floor(F.greatest(s1, s2) / width)))
    return both.drop("_bin")


def filter_by_regions(points: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """Points (chrom, pos) in any region, both ends included; a semi join on bins."""
    near = points.withColumn("_bin", F.floor(F.col("pos") / width))
    r = regions.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("stop").alias("_e"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("_b"))
    on = (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & F.col("pos").between(F.col("_s"), F.col("_e"))
    return near.join(r, on, "left_semi").drop("_bin")


def region_counts(points: DataFrame, regions: DataFrame, value: str, width: int) -> DataFrame:
    """Sum of ``value`` per region and sample. Points are summed by position first."""
    sums = points.groupBy("chrom", "pos", "sample").agg(F.sum(value).alias("_v"))
    both = overlap_join(regions, sums.withColumn("_pos", F.col("pos")), width, ("start", "stop"), ("pos", "_pos"))
    return both.groupBy("region", "sample").agg(F.sum("_v").alias(value))


def pile(tracks: DataFrame, keys: list[str], weights: dict[str, Column], tile: int = TILE) -> DataFrame:
    """(keys, from, to, and each of ``weights`` summed): disjoint stretches that tracks (keys, from, to; closed) of one key cover.

    Where tracks begin and end is counted before it is sorted, and sums run anew in every ``tile`` bases, where stretches end too, so neither a chromosome nor
    a place where many tracks lie is one task. Weights must be finite.
    """
    kind = dict(tracks.dtypes)["from"]
    rows = tracks.where(F.col("from") <= F.col("to")).select(*keys, "from", "to", F.lit(1).cast("long").alias("_n"), *[w.alias(c) for c, w in weights.items()])
    rows = rows.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("from") / tile), F.floor(F.col("to") / tile))))
    first, names = F.col("_tile") * tile, ["_n", *weights]
    ends = F.array(F.struct(F.greatest(F.col("from"), first).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("to").cast("long") + 1).alias("at"), F.lit(-1).alias("sign")))
    events = rows.select(*keys, "_tile", *names, F.explode(ends).alias("e")).where(F.col("e.at") < first + tile)
    events = events.groupBy(*keys, "_tile", F.col("e.at").alias("_at")).agg(*[F.sum(F.col(c) * F.col("e.sign")).alias(c) for c in names])
    w = Window.partitionBy(*keys, "_tile").orderBy("_at")
    events = events.withColumn("_to", F.coalesce(F.lead("_at").over(w), first + tile) - 1).withColumns({c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in names})
    return events.where("_n > 0").select(*keys, F.col("_at").cast(kind).alias("from"), F.col("_to").cast(kind).alias("to"), *weights)


def _overlap_counts(spans: DataFrame, rows: DataFrame, tile: int) -> DataFrame:
    """(chrom, _s, _e, counts): for distinct closed ``spans`` how many ``rows`` of each biotype overlap them, as an array of (biotype, n).

    What overlaps a span covers its start or begins behind it. What has begun is counted anew in every tile, so only biotypes
    near a span are looked at: n is the cover at its start, less what has begun in that tile by then, plus what has begun in each of its tiles up to its end.
    """
    end = (F.floor(F.col("start") / tile) + 1) * tile - 1
    count = {"n": F.lit(1).cast("long")}
    cover = pile(rows.select("chrom", "biotype", F.col("start").cast("long").alias("from"), F.col("stop").cast("long").alias("to")), ["chrom", "biotype"], count, tile)
    begun = settle(pile(rows.select("chrom", "biotype", F.col("start").cast("long").alias("from"), end.alias("to")), ["chrom", "biotype"], count, tile))
    tiles = F.explode(F.sequence(F.floor(F.col("_s") / tile), F.floor(F.col("_e") / tile))).alias("_t")
    starts = spans.select("chrom", "_s", "_e", F.col("_s").cast("long").alias("x"))
    ends = spans.select("chrom", "_s", "_e", tiles).select("chrom", "_s", "_e", F.least(F.col("_e").cast("long"), (F.col("_t") + 1) * tile - 1).alias("x"))

    def looked_up(points: DataFrame, stretches: DataFrame) -> DataFrame:
        """(chrom, _s, _e, biotype, n) of the stretches at x. A place is looked up once."""
        at = points.select("chrom", "x", F.col("x").alias("_x")).distinct()
        found = overlap_join(at, stretches, tile, ("x", "_x"), ("from", "to")).groupBy("chrom", "x").agg(F.collect_list(F.struct("biotype", "n")).alias("found"))
        return points.join(settle(found), ["chrom", "x"]).select("chrom", "_s", "_e", F.inline("found"))

    at_start = cover.unionByName(begun.withColumn("n", -F.col("n")))
    sums = looked_up(starts, at_start).union(looked_up(ends, begun)).groupBy("chrom", "_s", "_e", "biotype").agg(F.sum("n").alias("n")).where("n > 0")
    return settle(sums.groupBy("chrom", "_s", "_e").agg(F.collect_list(F.struct("biotype", "n")).alias("counts")))


def annotate_overlaps(regions: DataFrame, annotation: DataFrame, extend: int, width: int) -> DataFrame:
    """(region, biotype, n): annotations of each type that overlap a region widened on both sides (start floor 0).

    Pairs are counted, not made, and equal spans of regions are counted once. Only what stops before it starts is joined pair by pair.
    """
    wide = regions.select("region", "chrom", F.greatest(F.col("start") - extend, F.lit(0)).alias("_s"), (F.col("stop") + extend).alias("_e"))
    rows = annotation.select("chrom", "biotype", "start", "stop")
    good = wide.where("_s <= _e")
    counted = _overlap_counts(good.select("chrom", "_s", "_e").distinct(), rows.where("start <= stop"), width)
    counts = good.join(counted, ["chrom", "_s", "_e"]).select("region", F.inline("counts"))
    named = wide.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("_s > _e")).alias("odd"))
    if named.where("n > 1 or odd").isEmpty() and rows.where("start > stop").isEmpty():
        return counts
    odd = [overlap_join(wide.where("_s > _e"), rows, width, ("_s", "_e")), overlap_join(good, rows.where("start > stop"), width, ("_s", "_e"))]
    both = reduce(DataFrame.union, [p.select("region", "biotype", F.lit(1).cast("long").alias("n")) for p in odd], counts)
    return both.groupBy("region", "biotype").agg(F.sum("n").alias("n"))


def nearest_feature(regions: DataFrame, features: DataFrame, pieces: int = 512) -> DataFrame:
    """(region, feature, distance) of the nearest feature position on the chromosome; ties take the smaller position, then name.

    Regions and features are put in one order; the last feature before and the first after each region's
    middle are its candidates. The order is cut into ``pieces`` per chromosome, and each piece gets the
    last and first feature of the others from a small table, so a chromosome is many tasks. Equal middles are sought once.
    """
    span = features.agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"))
    spot = features.groupBy("chrom", "pos").agg(F.min("feature").alias("feature"))
    piece = F.greatest(F.lit(0), F.least(F.lit(pieces - 1), F.floor((F.col("pos") - F.col("lo")) * pieces / (F.col("hi") - F.col("lo"))))).cast("int")
    mid = regions.select("region", "chrom", F.floor((F.col("start") + F.col("stop")) / 2).alias("pos"))
    rows = spot.select("chrom", "pos", F.struct("pos", "feature").alias("f"))
    asked = mid.select("chrom", "pos").distinct()
    rows = rows.unionByName(asked.withColumn("f", F.lit(None).cast(rows.schema["f"].dataType))).join(F.broadcast(span), F.lit(True)).withColumn("piece", piece).drop("lo", "hi")
    ends = rows.where("f is not null").groupBy("chrom", "piece").agg(F.max("f").alias("last"), F.min("f").alias("first"))
    all_ = ends.select("chrom").distinct().select("chrom", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")).join(ends, ["chrom", "piece"], "left")
    order = Window.partitionBy("chrom").orderBy("piece")
    outer = all_.select("chrom", "piece", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before0"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after0"))
    here = Window.partitionBy("chrom", "piece").orderBy("pos")
    near = rows.withColumn("before", F.last("f", True).over(here.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("f", True).over(here.rangeBetween(0, Window.unboundedFollowing)))
    near = near.where("f is null").join(outer, ["chrom", "piece"], "left")
    choices = F.array_compact(F.array(F.coalesce("before", "before0"), F.coalesce("after", "after0")))
    best = F.array_min(F.transform(choices, lambda c: F.struct(F.abs(c["pos"] - F.col("pos")).alias("distance"), c["pos"].alias("at"), c["feature"].alias("feature"))))
    found = settle(near.select("chrom", "pos", best.alias("b")).where("b is not null").select("chrom", "pos", "b.feature", "b.distance"))
    return mid.join(found, ["chrom", "pos"]).select("region", "feature", "distance")
