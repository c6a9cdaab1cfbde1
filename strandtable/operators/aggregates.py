"""Aggregations, summaries, windows and reshaping."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import across_pieces, join_on_keys, row_places, sum_below, with_piece
from ..functions.storage import settle


def count_by_chromosome(df: DataFrame, condition: Column | None = None, chromosomes: list[str] | None = None) -> DataFrame:
    """Filtered features per chromosome; no list of chromosomes means all."""
    rows = df if condition is None else df.where(condition)
    rows = rows.where(F.col("chrom").isin(chromosomes)) if chromosomes else rows
    return rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def average_duplicates(tables: list[DataFrame]) -> DataFrame:
    """Mean of equal (feature, sample) cells over files, for features that all files have."""
    rows = reduce(DataFrame.unionByName, [t.withColumn("_t", F.lit(k)) for k, t in enumerate(tables)])
    all_ = rows.groupBy("feature").agg(F.countDistinct("_t").alias("n")).where(F.col("n") == len(tables)).select("feature")
    return rows.join(all_, "feature", "left_semi").groupBy("feature", "sample").agg(F.avg("value").alias("value"))


def single_gene_probes(probes: DataFrame) -> DataFrame:
    """Probes (probe, gene) that map to exactly one gene."""
    return probes.groupBy("probe").agg(F.min("gene").alias("gene"), F.max("gene").alias("_g")).where("gene = _g").drop("_g")


def collapse_probes(values: DataFrame, probes: DataFrame) -> DataFrame:
    return values.join(probes, "probe").groupBy("gene", "sample").agg(F.avg("value").alias("value"))


def sample_detection(m: DataFrame, least: float) -> DataFrame:
    return m.groupBy("sample").agg(F.count_if(F.col("value") > least).alias("detected"), F.sum("value").alias("total"))


def zero_frequency(m: DataFrame, features: int) -> DataFrame:
    """Share of features without counts per sample (absent cells are zero)."""
    n = F.count_if(F.col("value") != 0)
    return m.groupBy("sample").agg((1 - n / features).alias("zero"), (n / features).alias("nonzero"))


def zero_histogram(m: DataFrame, sheet: DataFrame) -> DataFrame:
    """(condition, zeros, n): features by the number of a condition's samples in which they are zero."""
    sizes = sheet.groupBy("condition").agg(F.countDistinct("sample").alias("size"))
    per = m.where("value <> 0").join(sheet.select("sample", "condition"), "sample").groupBy("condition", "feature").agg(F.countDistinct("sample").alias("k"))
    return per.join(sizes, "condition").groupBy("condition", (F.col("size") - F.col("k")).alias("zeros")).agg(F.count(F.lit(1)).alias("n"))


def contig_sizes(sequences: DataFrame) -> DataFrame:
    """Total length per contig and its header line."""
    out = sequences.groupBy("contig").agg(F.sum(F.length("seq")).alias("length"))
    return out.withColumn("header", F.format_string("##contig=<ID=%s,length=%d>", F.col("contig"), F.col("length")))


def binned_mean(df: DataFrame, keys: list[str], pos: str, value: str, width: int) -> DataFrame:
    """Mean per bin of ``width`` positions, from 0 to each key's last bin; empty bins are 0."""
    means = df.groupBy(*keys, F.floor(F.col(pos) / width).alias("bin")).agg(F.avg(value).alias("mean"))
    span = means.groupBy(*keys).agg(F.max("bin").alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("bin"))
    return span.join(means, [*keys, "bin"], "left").fillna(0.0, ["mean"])


def genome_offsets(sizes: DataFrame) -> DataFrame:
    """Running offset of each contig in name order; there is one row per contig."""
    before = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def composition_rollup(df: DataFrame) -> DataFrame:
    """Abundance per sample by genus, and by genus and species; ``sp.`` counts to its genus alone."""
    named = df.withColumn("species", F.when(F.col("species") != "sp.", F.col("species")))
    out = named.rollup("sample", "genus", "species").agg(F.sum("abundance").alias("abundance"), F.grouping_id().alias("_g"))
    return out.where("_g = 1 or _g = 0 and species is not null").select("sample", "genus", F.when(F.col("_g") == 1, "").otherwise(F.col("species")).alias("species"), "abundance")


def group_junction_median(j: DataFrame, groups: DataFrame) -> DataFrame:
    return j.join(groups, "sample").groupBy("condition", "start", "stop").agg(F.median("reads").alias("reads"))


def group_coverage_mean(c: DataFrame, groups: DataFrame) -> DataFrame:
    """Coverage sum over the number of samples in the group, per position."""
    n = groups.groupBy("condition").agg(F.countDistinct("sample").alias("n"))
    return c.join(groups, "sample").groupBy("condition", "pos").agg(F.sum("value").alias("s")).join(n, "condition").select("condition", "pos", (F.col("s") / F.col("n")).alias("coverage"))


def normalize_junctions(j: DataFrame, totals: DataFrame) -> DataFrame:
    """Reads per million of the sample's total."""
    return j.join(totals, "sample").withColumn("norm_reads", F.when(F.col("total") > 0, F.col("reads") * 1e6 / F.col("total")).otherwise(0.0))


def condition_summary(values: DataFrame) -> DataFrame:
    v = F.col("value")
    return values.groupBy("condition").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"))


def methylation_ratio(meth: Column, unmeth: Column, least: int) -> Column:
    """m / (m + u + 1); 0 under ``least`` reads."""
    return F.when(meth + unmeth + 1 < least, 0.0).otherwise(meth / (meth + unmeth + 1))


def hyper_hypo(df: DataFrame, p_limit: float, difference: float) -> DataFrame:
    hit = (F.col("pvalue") < p_limit) & (F.abs("difference") >= difference)
    return df.where(hit).groupBy("chrom").agg(F.count_if(F.col("difference") > 0).alias("hyper"), F.count_if(F.col("difference") < 0).alias("hypo"))


def motif_hits(hits: DataFrame, p_limit: float) -> DataFrame:
    """Distinct sequences per motif in each set (``experiment`` or ``background``)."""
    sites = hits.dropDuplicates(["set", "motif", "sequence", "start", "stop", "strand"]).where(F.col("pvalue") < p_limit)
    count = lambda s: F.countDistinct(F.when(F.col("set") == s, F.col("sequence"))).alias(s)
    return sites.groupBy("motif").agg(count("experiment"), count("background"))


def strandness(counts: DataFrame) -> DataFrame:
    """Softmax over the shares of each strand's counts; a call needs more than 0.9 of it."""
    shares = counts.agg(*[(F.sum(s) / F.sum(F.col("unstranded") + F.col("first") + F.col("second"))).alias(s) for s in ("unstranded", "first", "second")])
    e = {s: F.exp(F.col(s) * 10) for s in ("unstranded", "first", "second")}
    whole = e["unstranded"] + e["first"] + e["second"]
    p = {s: e[s] / whole for s in e}
    call = reduce(lambda w, s: w.when(p[s] > 0.9, s), ["first", "second"], F.when(p["unstranded"] > 0.9, "unstranded")).otherwise("unclear")
    return shares.select(*[p[s].alias(s) for s in p], call.alias("call"))


def gene_set_sizes(t2g: DataFrame, least: int, most: int) -> DataFrame:
    return t2g.distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))


def peak_gene_classes(peaks: DataFrame, p_limit: float | None = None) -> DataFrame:
    """Genes with one peak, or several that agree or disagree in direction."""
    rows = peaks if p_limit is None else peaks.where(F.col("padj") < p_limit)
    up, down, n = F.count_if(F.col("log2FoldChange") > 0), F.count_if(F.col("log2FoldChange") < 0), F.count(F.lit(1))
    kind = F.when(n == 1, "one_peak").when((up == n) | (down == n), "multi_concordant").otherwise("multi_discordant")
    return rows.groupBy("gene").agg(kind.alias("class"), n.alias("n_peaks"))


def vep_flatten(rows: DataFrame) -> DataFrame:
    """One row per transcript consequence term of parsed annotation (input, consequences)."""
    return rows.select("input", F.explode_outer("consequences").alias("c")).select("input", "c.gene", "c.impact", F.explode_outer("c.terms").alias("term"))


def lowest_frequency(frequencies: Column, population: str = "amr") -> Column:
    """The population's frequency if there is one, else the least of all, else ``unknown``."""
    mine = F.element_at(frequencies, population)
    return F.coalesce(mine.cast("string"), F.array_min(F.map_values(frequencies)).cast("string"), F.lit("unknown"))


# Windows, sorts, top-k


def running_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, valid: bool = False) -> DataFrame:
    """Mean over the ``width // 2`` rows before and from the own row on; ``valid`` drops cut windows."""
    h = width // 2
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("running", F.avg(value).over(w.rowsBetween(-h, h - 1)))
    if valid:
        out = out.withColumns({"_k": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))}).where((F.col("_k") > h) & (F.col("_k") <= F.col("_n") - h + 1)).drop("_k", "_n")
    return out


def kneedle(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Knee of each key's values in falling order: first place where the line from max to min is highest above them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = counts.groupBy(*keys).agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.sum("c").alias("n"))
    # The line falls, so of equal values the first place has the greatest gap.
    rows = join_on_keys(sum_below(counts, keys, "v", "c", "below"), ends, keys).withColumn("i", F.col("n") - F.col("below") - F.col("c"))
    gap = F.col("hi") + (F.col("lo") - F.col("hi")) * F.col("i") / F.col("n") - F.col("v")
    best = rows.withColumn("g", F.round(gap, 9)).groupBy(*keys).agg(F.max_by(F.struct("i", "v"), F.struct("g", -F.col("i"))).alias("k"))
    return best.select(*keys, F.col("k.i").alias("index"), F.col("k.v").alias("value"))


def merge_intervals(df: DataFrame) -> DataFrame:
    """Unions of overlapping or touching intervals per chromosome."""
    rows = with_piece(df.select("chrom", "start", "stop").distinct(), "start")
    w = Window.partitionBy("chrom", "_piece").orderBy("start", "stop")
    rows = across_pieces(rows, ["chrom"], {"carried": ("max", F.max("stop"))})
    reach = F.greatest("carried", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("new", (F.coalesce(F.col("start") > reach + 1, F.lit(True))).cast("int"))
    rows = across_pieces(rows.select("chrom", "start", "stop", "_piece", "new"), ["chrom"], {"earlier": ("sum", F.sum("new"))})
    rows = rows.withColumn("g", F.coalesce("earlier", F.lit(0)) + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("chrom", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("g")


def exon_numbering(exons: DataFrame) -> DataFrame:
    """E1, E2 ... along the strand."""
    along = F.when(F.col("strand") == "-", -F.col("stop")).otherwise(F.col("start"))
    return exons.withColumn("exon", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy("gene").orderBy(along, "start", "stop")).cast("string")))


def introns_from_exons(exons: DataFrame) -> DataFrame:
    nxt = F.lead("start").over(Window.partitionBy("gene").orderBy("start", "stop"))
    return exons.withColumn("_n", nxt).where(F.col("_n") > F.col("stop") + 1).select("gene", (F.col("stop") + 1).alias("start"), (F.col("_n") - 1).alias("stop"))


def top_n_genes(df: DataFrame, n: int, absolute: bool = False) -> DataFrame:
    """``n`` smallest padj overall, or of each direction; ties by name."""
    if absolute:
        return df.orderBy("padj", "gene_symbol").limit(n)
    top = lambda c: df.where(c).orderBy("padj", "gene_symbol").limit(n)
    return top("log2FoldChange > 0").union(top("log2FoldChange < 0"))


def best_peak_per_gene(peaks: DataFrame, p_limit: float = 0.05) -> DataFrame:
    """One peak of each gene whose peaks agree: greatest significant change, else least padj; discordant genes go."""
    sig = F.col("padj") < p_limit
    s = F.struct(F.abs("log2FoldChange").alias("c"), F.col("peak_id").alias("p"), F.col("log2FoldChange").alias("f"), F.col("padj").alias("q"))
    a = peaks.groupBy("gene").agg(
        F.count_if(sig & (F.col("log2FoldChange") > 0)).alias("su"), F.count_if(sig & (F.col("log2FoldChange") < 0)).alias("sd"),
        F.count_if(F.col("log2FoldChange") > 0).alias("u"), F.count_if(F.col("log2FoldChange") < 0).alias("d"),
        F.max(F.when(sig, s)).alias("top"), F.min(F.struct(F.col("padj").alias("q"), F.col("peak_id").alias("p"), F.col("log2FoldChange").alias("f"))).alias("low"),
    )
    keep = F.when(F.col("su") + F.col("sd") > 0, (F.col("su") == 0) | (F.col("sd") == 0)).otherwise((F.col("u") == 0) | (F.col("d") == 0))
    return a.where(keep).select("gene", F.coalesce("top.p", "low.p").alias("peak_id"), F.coalesce("top.f", "low.f").alias("log2FoldChange"), F.coalesce("top.q", "low.q").alias("padj"))


def drop_ambiguous_names(df: DataFrame, name: str) -> DataFrame:
    """Rows whose name no other row has."""
    return df.join(df.groupBy(name).count().where("count = 1").select(name), name, "left_semi")


# Consequence terms from most to least severe.
SEVERITY = "transcript_ablation splice_acceptor_variant splice_donor_variant stop_gained frameshift_variant stop_lost start_lost transcript_amplification feature_elongation feature_truncation inframe_insertion inframe_deletion missense_variant protein_altering_variant splice_donor_5th_base_variant splice_region_variant splice_donor_region_variant splice_polypyrimidine_tract_variant incomplete_terminal_codon_variant start_retained_variant stop_retained_variant synonymous_variant coding_sequence_variant mature_miRNA_variant 5_prime_UTR_variant 3_prime_UTR_variant non_coding_transcript_exon_variant intron_variant NMD_transcript_variant non_coding_transcript_variant coding_transcript_variant upstream_gene_variant downstream_gene_variant TFBS_ablation TFBS_amplification TF_binding_site_variant regulatory_region_ablation regulatory_region_amplification regulatory_region_variant intergenic_variant sequence_variant".split()


def most_severe_effect(rows: DataFrame, keys: list[str], ranks: list[str] = SEVERITY) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ranks)), F.col("term"))
    rank = F.when(place == 0, len(ranks) + 1).otherwise(place)
    return rows.groupBy(*keys).agg(F.min_by("term", F.struct(rank, F.col("term"))).alias("term"))


def top_k_matches(scores: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "tag_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_categories(df: DataFrame, p_limit: float = 0.05, n: int = 15, score: str = "log2ratio") -> DataFrame:
    """Significant rows by padj; infinite scores become max(1, max) and min(-1, min)."""
    s = F.col(score)
    finite = F.abs(s) != float("inf")
    ends = df.agg(F.greatest(F.lit(1.0), F.max(F.when(finite, s))).alias("_hi"), F.least(F.lit(-1.0), F.min(F.when(finite, s))).alias("_lo"))
    out = df.where(F.col("padj") < p_limit).join(F.broadcast(ends), F.lit(True))
    out = out.withColumn(score, F.when(s == float("inf"), F.col("_hi")).when(s == float("-inf"), F.col("_lo")).otherwise(s)).drop("_hi", "_lo")
    return out.orderBy("padj", "category").limit(n)


def one_hot_code(df: DataFrame, flags: list[str]) -> DataFrame:
    """Concatenated flags, by which patients are ordered."""
    return df.withColumn("code", F.concat(*[F.col(f).cast("int").cast("string") for f in flags]))


def balanced_splits(rows: DataFrame, n: int, batch: int, seed: int = 1, validation: bool = False, cover: bool = False) -> DataFrame:
    """(split, label, id): each split takes ``batch`` rows of each label, going on where the last ended and cycling.

    With ``validation`` a column ``part`` tells ``train`` from ``validation``, the next ``batch`` rows of the label, as far as it
    has rows that the split does not train on. ``cover`` makes at least as many splits as use every row once. Places in a
    label come from ranges of a seeded order, so a label of most rows is many tasks.
    """
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), F.col("id")]
    ranked = row_places(rows.select("id", "label"), order, ["label"], "k")
    sizes = settle(ranked.groupBy("label").agg(F.count(F.lit(1)).alias("size")))
    if cover:
        n = max(n, math.ceil((sizes.agg(F.max("size")).first()[0] or 0) / batch))
    ranked = join_on_keys(ranked, sizes, ["label"])
    turns = lambda first, last: F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.col("size").cast("long")))
    k, whole = F.col("k"), F.lit(n * batch - 1)
    train = ranked.select("label", "id", F.explode(turns(k, whole)).alias("at")).select(F.floor(F.col("at") / batch).cast("int").alias("split"), "label", "id")
    if not validation:
        return train
    # The row at a place validates the split before it, unless that split has come round to it already.
    later = ranked.where(F.col("size") > batch).select("label", "id", "size", F.explode(turns(k + F.when(k < batch, F.col("size")).otherwise(0), whole + batch)).alias("at"))
    spare = later.select((F.floor(F.col("at") / batch) - 1).cast("int").alias("split"), "label", "id", (F.col("at") % batch).alias("i"), "size").where(F.col("i") < F.col("size") - batch)
    return train.select("split", F.lit("train").alias("part"), "label", "id").union(spare.select("split", F.lit("validation"), "label", "id"))


# Reshaping and sets


def melt(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "sample", "value")


def pivot(m: DataFrame, samples: list, fill: float = 0.0) -> DataFrame:
    return m.groupBy("feature").pivot("sample", samples).agg(F.sum("value")).fillna(fill)


def frequent_values(df: DataFrame, column: str, least: int = 3, cover: float = 0.75, limit: int = 1001) -> list | None:
    """Values of a category: those seen over ``least`` times, if they cover ``cover`` of the rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n"), F.sum(F.when(F.col("n") > least, F.col("n")))).first()
    if not total[0] or (total[1] or 0) < cover * total[0]:
        return None
    return sorted(r[0] for r in counts.where((F.col("n") > least) & F.col(column).isNotNull()).limit(limit).collect())


def one_hot(df: DataFrame, columns: list[str], most: int = 1000) -> DataFrame:
    """Categories become boolean columns ``col_value`` and lose their own; other columns stay.

    A category of over ``most`` frequent values makes no columns but an error; ``one_hot_cells`` has no such limit.
    """
    for c in columns:
        found = frequent_values(df, c, limit=most + 1)
        if found and len(found) > most:
            raise ValueError(f"{c} has over {most} frequent values")
        if found:
            df = df.select(*[x for x in df.columns if x != c], *[F.coalesce(F.col(c) == x, F.lit(False)).alias(f"{c}_{x}") for x in found])
    return df


def one_hot_cells(df: DataFrame, key: str, columns: list[str], least: int = 3, cover: float = 0.75) -> DataFrame:
    """(key, name): the true cells of ``one_hot``, a row each, for categories of any number of values.

    Frequent values are counted for all columns in one scan and stay distributed.
    """
    cells = df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("key", "x.*")
    counts = settle(cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    whole = counts.groupBy("column").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") > least, F.col("n")).otherwise(0)).alias("some")).where(F.col("some") >= cover * F.col("all"))
    kept = counts.where((F.col("n") > least) & F.col("value").isNotNull()).join(F.broadcast(whole.select("column")), "column").select("column", "value")
    return cells.join(kept, ["column", "value"]).select("key", F.concat_ws("_", "column", "value").alias("name"))


def union_reports(reports: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def distinct_tags(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.split(column, r"; ?")).alias("tag")).where("tag <> ''").distinct()


def gene_universe(genes: DataFrame, t2g: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """The background, else all genes of list and sets."""
    sources = [background] if background is not None else [genes, t2g]
    return reduce(DataFrame.union, [s.select("gene_symbol") for s in sources]).where("gene_symbol is not null").distinct()


def dedupe_exons(exons: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row, in file order, of each exon."""
    others = [c for c in exons.columns if c not in keys]
    first = exons.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_f"))
    return first.select(*keys, "_f.*")

