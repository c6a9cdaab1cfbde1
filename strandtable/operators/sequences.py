"""Sequences (contig, seq), alleles and signal around genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import settle
from .aggregates import running_average
from .joins import overlap_join, pile


def kmers(seqs: DataFrame, k: int, key: str = "contig") -> DataFrame:
    """(key, pos, kmer) of all k-mers."""
    span = F.when(F.length("seq") >= k, F.sequence(F.lit(0), F.length("seq") - k)).otherwise(F.array().cast("array<int>"))
    return seqs.select(key, "seq", F.explode(span).alias("pos")).select(key, "pos", F.substring("seq", F.col("pos") + 1, F.lit(k)).alias("kmer"))


def chunk_kmers(chunks: DataFrame, k: int) -> DataFrame:
    """(contig, pos, kmer) of sequences in chunks (contig, chunk, offset, seq; all but a contig's last of ``k`` letters or more).

    Each chunk gets the first letters of the next one, so k-mers over the border are made once, by the chunk that they begin in.
    """
    heads = chunks.select("contig", (F.col("chunk") - 1).alias("chunk"), F.substring("seq", 1, k - 1).alias("_more"))
    whole = chunks.join(heads, ["contig", "chunk"], "left").select("contig", "offset", F.length("seq").alias("_own"), F.concat("seq", F.coalesce("_more", F.lit(""))).alias("seq"))
    last = F.least(F.col("_own") - 1, F.length("seq") - k)
    span = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = whole.select("contig", "offset", "seq", F.explode(span).alias("i"))
    return rows.select("contig", (F.col("offset") + F.col("i")).alias("pos"), F.substring("seq", F.col("i") + 1, F.lit(k)).alias("kmer"))


def distinct_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """The k-mers of whole sequences or of chunks."""
    return (chunk_kmers if "chunk" in seqs.columns else kmers)(seqs, k).select("kmer").distinct()


def kmer_anchors(queries: DataFrame, subjects: DataFrame, k: int, least: int = 2, match: float = 1.0, mismatch: float = -1.0) -> DataFrame:
    """Runs of query k-mers at one offset of a subject, by first occurrence: ranges, equal bases, coverage, identity, score.

    ``matches`` counts the equal bases of the run's range, ``identity`` is their share of it, and ``score`` adds
    ``match`` and ``mismatch`` over it. ``coverage`` is the range's share of the query.
    """
    q = kmers(queries, k).withColumnRenamed("contig", "query")
    s = kmers(subjects, k).groupBy(F.col("contig").alias("subject"), "kmer").agg(F.min("pos").alias("at"))
    hits = q.join(s, "kmer").withColumn("offset", F.col("at") - F.col("pos"))
    runs = hits.groupBy("query", "subject", "offset").agg(F.count(F.lit(1)).alias("anchors"), F.min("pos").alias("start"), (F.max("pos") + k).alias("stop")).where(F.col("anchors") >= least)
    long = F.col("stop") - F.col("start")
    out = runs.join(queries.select(F.col("contig").alias("query"), F.length("seq").alias("n"), F.col("seq").alias("_q")), "query").withColumn("_q", F.substring("_q", F.col("start") + 1, long))
    out = out.join(subjects.select(F.col("contig").alias("subject"), F.col("seq").alias("_s")), "subject").withColumn("_s", F.substring("_s", F.col("start") + F.col("offset") + 1, long))
    matches = F.size(F.filter(F.zip_with(F.split("_q", ""), F.split("_s", ""), lambda a, b: a == b), lambda x: x))
    out = out.withColumn("matches", F.when(F.col("_q") == F.col("_s"), long).otherwise(matches))
    score = match * F.col("matches") + mismatch * (long - F.col("matches"))
    return out.select("query", "subject", "offset", "anchors", "start", "stop", "matches", (long / F.col("n")).alias("coverage"), (F.col("matches") / long).alias("identity"), score.alias("score"))


def anchor_alignment(runs: DataFrame, queries: DataFrame, subjects: DataFrame, match: float = 1.0, mismatch: float = -1.0) -> DataFrame:
    """One gapped alignment for each query and subject from its runs: (query, subject, length, coverage, identity, score, normalised).

    A base that several runs cover is aligned at the greatest offset. ``length`` goes from the first to the last aligned base,
    coverage and identity are percents (of the query, of that length), and the score is normalised by length over the query's.
    """
    bases = runs.select("query", "subject", "offset", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))
    bases = bases.groupBy("query", "subject", "pos").agg(F.max("offset").alias("offset"))
    # Bases of one offset that follow each other are one piece again, so that each piece fetches its sequences once.
    w = Window.partitionBy("query", "subject", "offset").orderBy("pos")
    pieces = bases.withColumn("piece", F.col("pos") - F.row_number().over(w)).groupBy("query", "subject", "offset", "piece").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    long = F.col("stop") - F.col("start")
    pieces = pieces.join(queries.select(F.col("contig").alias("query"), F.length("seq").alias("n"), F.col("seq").alias("_q")), "query").withColumn("_q", F.substring("_q", F.col("start") + 1, long))
    pieces = pieces.join(subjects.select(F.col("contig").alias("subject"), F.col("seq").alias("_s")), "subject").withColumn("_s", F.substring("_s", F.col("start") + F.col("offset") + 1, long))
    equal = F.size(F.filter(F.zip_with(F.split("_q", ""), F.split("_s", ""), lambda a, b: a == b), lambda x: x))
    s = pieces.groupBy("query", "subject", "n").agg(F.sum(equal).alias("m"), F.sum(long).alias("all"), (F.max("stop") - F.min("start")).alias("length"))
    score = match * F.col("m") + mismatch * (F.col("all") - F.col("m"))
    return s.select("query", "subject", "length", (100 * F.col("all") / F.col("n")).alias("coverage"), (100 * F.col("m") / F.col("length")).alias("identity"), score.alias("score"), (score * F.col("length") / F.col("n")).alias("normalised"))


def fill_anchor_gaps(anchors: DataFrame, queries: DataFrame, subjects: DataFrame, k: int = 5) -> DataFrame:
    """Short k-mer matches between neighbouring runs of one query and subject."""
    w = Window.partitionBy("query", "subject").orderBy("start", "offset")
    gaps = anchors.withColumns({"next": F.lead("start").over(w), "next_offset": F.lead("offset").over(w)}).where(F.col("next") - F.col("stop") >= k)
    gaps = gaps.select("query", "subject", F.col("stop").alias("from"), F.col("next").alias("to"), (F.col("stop") + F.col("offset")).alias("s_from"), (F.col("next") + F.col("next_offset")).alias("s_to")).where("s_to > s_from and s_from >= 0")
    cut = lambda c, a, b: F.substring(c, F.col(a) + 1, F.col(b) - F.col(a))
    parts = gaps.join(queries.select(F.col("contig").alias("query"), "seq"), "query").withColumn("q", cut("seq", "from", "to")).drop("seq")
    parts = parts.join(subjects.select(F.col("contig").alias("subject"), "seq"), "subject").withColumn("s", cut("seq", "s_from", "s_to")).drop("seq")
    keys = ["query", "subject", "from"]
    name = F.struct(*keys).alias("contig")
    found = kmer_anchors(parts.select(name, F.col("q").alias("seq")), parts.select(name, F.col("s").alias("seq")), k, 1).where(F.col("query") == F.col("subject"))
    return found.select(F.col("query.query").alias("query"), F.col("query.subject").alias("subject"), (F.col("start") + F.col("query.from")).alias("start"), (F.col("stop") + F.col("query.from")).alias("stop"), "anchors")


def gapless_overlap(pairs: DataFrame, least: int = 5) -> DataFrame:
    """(pair, offset, score, start, stop): best gapless overlap of ``a`` and ``b`` by +1 / -1, trimmed at both ends for the best score."""
    na, nb = F.length("a"), F.length("b")
    rows = pairs.select("pair", "a", "b", F.explode(F.sequence(-(na - least), nb - least)).alias("offset")).where((na >= least) & (nb >= least))
    rows = rows.withColumns({"from": F.greatest(F.lit(0), -F.col("offset")), "to": F.least(na, nb - F.col("offset"))}).where(F.col("to") - F.col("from") >= least)
    cells = rows.select("pair", "offset", F.explode(F.transform(F.sequence(F.col("from"), F.col("to") - 1), lambda i: F.struct(i.alias("i"), F.when(F.substring("a", i + 1, F.lit(1)) == F.substring("b", i + F.col("offset") + 1, F.lit(1)), 1).otherwise(-1).alias("v")))).alias("x")).select("pair", "offset", "x.*")
    score = cells.groupBy("pair", "offset").agg(F.sum("v").alias("score"))
    best = score.groupBy("pair").agg(F.max(F.struct("score", -F.abs("offset"), "offset")).alias("m")).select("pair", F.col("m.offset").alias("offset"))
    w = Window.partitionBy("pair").orderBy("i")
    run = cells.join(best, ["pair", "offset"]).withColumn("sum", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("sum") - F.col("v"))
    low = F.min(F.struct("before", "i")).over(w.rowsBetween(Window.unboundedPreceding, -(least - 1)))
    ends = run.withColumn("low", low).where("low is not null")
    top = ends.groupBy("pair", "offset").agg(F.max(F.struct((F.col("sum") - F.col("low.before")).alias("score"), F.col("i").alias("stop"), F.col("low.i").alias("start"))).alias("m"))
    return top.select("pair", "offset", "m.score", "m.start", (F.col("m.stop") + 1).alias("stop"))


def promoter_windows(genes: DataFrame, seqs: DataFrame, up: int, down: int) -> DataFrame:
    """Sequence from ``up`` before to ``down`` after each gene's first base along its strand (floor 0)."""
    minus = F.col("strand") == "-"
    start = F.greatest(F.lit(0), F.when(minus, F.col("stop") - down).otherwise(F.col("start") - up))
    stop = F.when(minus, F.col("stop") + up).otherwise(F.col("start") + down)
    rows = genes.withColumns({"from": start, "to": stop}).join(seqs.select(F.col("contig").alias("chrom"), "seq"), "chrom")
    return rows.select("gene", "strand", "from", "to", F.substring("seq", F.col("from") + 1, F.col("to") - F.col("from")).alias("promoter"))


def promoter_windows_in_chunks(genes: DataFrame, chunks: DataFrame, up: int, down: int, size: int = 1 << 16) -> DataFrame:
    """``promoter_windows`` on sequences in chunks of ``size`` (contig, chunk, offset, seq): a window fetches the chunks it touches."""
    minus = F.col("strand") == "-"
    start = F.greatest(F.lit(0), F.when(minus, F.col("stop") - down).otherwise(F.col("start") - up))
    stop = F.when(minus, F.col("stop") + up).otherwise(F.col("start") + down)
    rows = genes.withColumns({"from": start, "to": stop}).select("gene", "strand", "chrom", "from", "to")
    # A chunk may reach into the range of the next one.
    met = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("from") / size) - 1, F.floor(F.greatest(F.col("to") - 1, F.col("from")) / size))))
    met = met.join(chunks.withColumnRenamed("contig", "chrom"), ["chrom", "chunk"])
    low = F.greatest(F.col("from") - F.col("offset"), F.lit(0))
    part = F.substring("seq", (low + 1).cast("int"), F.greatest(F.col("to") - F.col("offset") - low, F.lit(0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("offset", part.alias("part"))))
    found = met.groupBy("gene", "strand", "from", "to").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("promoter"))
    return found.select("gene", "strand", "from", "to", "promoter")


def base_coverage(coverage: DataFrame, regions: DataFrame, width: int = 4096) -> DataFrame:
    """(region, sample, pos, value): per-base values of tracks (chrom, sample, from, to, value; closed) in regions."""
    both = overlap_join(regions.select("region", "chrom", "start", "stop"), coverage, width, ("start", "stop"), ("from", "to"))
    return both.select("region", "sample", F.explode(F.sequence(F.greatest("start", "from"), F.least("stop", "to"))).alias("pos"), "value")


def region_coverage(coverage: DataFrame, regions: DataFrame, groups: DataFrame) -> DataFrame:
    """Median over each group's samples, per base.

    A base has one median for all regions that it lies in, found once from its distinct values and their counts. Only regions
    of one name on several chromosomes mix their values, base by base.
    """
    tracks = coverage.join(groups, "sample")
    named = regions.select("region", "chrom", F.col("start").alias("from"), F.col("stop").alias("to"))
    bases = pile(named, ["chrom"], {}).select("chrom", F.col("from").alias("start"), F.col("to").alias("stop"))
    counts = pile(tracks, ["chrom", "condition", "value"], {"n": F.lit(1).cast("long")})
    cells = overlap_join(bases, counts, 64, ("start", "stop"), ("from", "to")).select("chrom", "condition", F.explode(F.sequence(F.greatest("start", "from"), F.least("stop", "to"))).alias("pos"), "value", "n")
    medians = settle(cells.groupBy("chrom", "condition", "pos").agg(F.percentile("value", 0.5, F.col("n")).alias("value")))
    spots = pile(named, ["region", "chrom"], {}).select("region", "chrom", F.explode(F.sequence("from", "to")).alias("pos"))
    several = named.groupBy("region").agg(F.min("chrom").alias("_lo"), F.max("chrom").alias("_hi")).where("_lo <> _hi").drop("_lo", "_hi")
    if several.isEmpty():
        return spots.join(medians, ["chrom", "pos"]).select("region", "condition", "pos", "value")
    several = settle(several)
    on = regions["region"].eqNullSafe(several["region"])
    mixed = base_coverage(coverage, regions.join(several, on, "left_semi")).join(groups, "sample").groupBy("region", "condition", "pos").agg(F.median("value").alias("value"))
    single = spots.join(several, spots["region"].eqNullSafe(several["region"]), "left_anti").join(medians, ["chrom", "pos"])
    return single.select("region", "condition", "pos", "value").union(mixed)


def tss_profile(coverage: DataFrame, genes: DataFrame, extend: int, smooth: int = 0) -> DataFrame:
    """(relative, value): mean signal around gene starts, flipped on ``-``, over genes and samples, positions without signal as 0.

    Tracks are summed into disjoint stretches and genes of one start and strand are counted first, so the work follows the
    stretches and starts, not the pairs of tracks and genes.
    """
    minus = F.coalesce(F.col("strand") == "-", F.lit(False))
    near = genes.groupBy("chrom", minus.alias("minus"), F.when(minus, F.col("stop")).otherwise(F.col("start")).alias("tss")).agg(F.count(F.lit(1)).alias("k"))
    near = near.withColumns({"start": F.greatest(F.lit(0), F.col("tss") - extend), "stop": F.col("tss") + extend})
    n = genes.agg(F.count(F.lit(1)).alias("_g")).join(coverage.agg(F.countDistinct("sample").alias("_s")), F.lit(True))
    v = F.col("value").cast("double")
    inf = F.lit(float("inf"))
    # Sums that run on cannot take back what is not finite, so that is counted instead.
    odd = {c: F.coalesce(is_odd, F.lit(False)).cast("long") for c, is_odd in (("nan", F.isnan(v)), ("up", v == inf), ("down", v == -inf), ("some", v.isNotNull()))}
    sums = pile(coverage, ["chrom"], {"v": F.when(F.abs(v) < inf, v).otherwise(0.0)} | odd)
    value = F.when(F.expr("nan > 0 or (up > 0 and down > 0)"), float("nan")).when(F.col("up") > 0, inf).when(F.col("down") > 0, -inf).when(F.col("some") > 0, F.col("v"))
    both = overlap_join(near, sums.select("chrom", "from", "to", value.alias("value")), max(64, 2 * extend + 1), ("start", "stop"), ("from", "to"))
    values = both.select("minus", "tss", F.explode(F.sequence(F.greatest("start", "from"), F.least("stop", "to"))).alias("pos"), (F.col("value") * F.col("k")).alias("value"))
    rel = F.when(F.col("minus"), F.col("tss") - F.col("pos")).otherwise(F.col("pos") - F.col("tss"))
    sums = values.groupBy(rel.alias("relative")).agg(F.sum("value").alias("s")).join(F.broadcast(n), F.lit(True))
    out = sums.select("relative", (F.col("s") / (F.col("_g") * F.col("_s"))).alias("value"))
    if not smooth:
        return out
    return running_average(out.withColumn("_one", F.lit(1)), ["_one"], ["relative"], "value", 2 * smooth).select("relative", F.col("running").alias("value"))


def region_of_gene(genes: DataFrame, peaks: DataFrame, extend: int, p_limit: float = 0.05) -> DataFrame:
    """A gene's span widened to its significant peaks and by ``extend``."""
    p = peaks.where(F.col("padj") < p_limit).groupBy("gene").agg(F.min("start").alias("_s"), F.max("stop").alias("_e"))
    rows = genes.join(p, "gene", "left")
    return rows.select("gene", "chrom", F.greatest(F.lit(0), F.least("start", F.coalesce("_s", "start")) - extend).alias("start"), (F.greatest("stop", F.coalesce("_e", "stop")) + extend).alias("stop"))


def methylation_tss_bins(differences: DataFrame, genes: DataFrame, extend: int = 5000, width: int = 50) -> DataFrame:
    """(gene, bin, value): mean difference per bin around each start; genes without any go."""
    near = genes.select("gene", "chrom", F.col("start").alias("tss"), (F.col("start") - extend).alias("_s"), (F.col("start") + extend).alias("_e"))
    d = differences.select("chrom", "pos", F.col("pos").alias("_pos"), "difference")
    both = overlap_join(near, d, max(width, 2 * extend), ("_s", "_e"), ("pos", "_pos"))
    return both.groupBy("gene", F.floor((F.col("pos") - F.col("tss")) / width).alias("bin")).agg(F.avg("difference").alias("value"))


def encode_allele(chrom: Column, pos: Column, base: Column) -> Column:
    return F.concat_ws(":", chrom.cast("string"), pos.cast("string"), base)


def decode_allele(key: Column) -> Column:
    p = F.split(key, ":")
    return F.struct(p[0].alias("chrom"), p[1].cast("long").alias("pos"), p[2].alias("base"))


def genotype_alleles(variants: DataFrame) -> DataFrame:
    """(…, allele, pos, base): reference (0) and equal-length alternatives base by base; ``<*>`` and indels have none."""
    alleles = F.posexplode(F.concat(F.array("ref"), F.split("alt", ","))).alias("allele", "seq")
    rows = variants.select("chrom", "pos", "ref", alleles).where((F.col("seq") != "<*>") & (F.length("seq") == F.length("ref")))
    one = rows.select("chrom", "pos", "allele", F.posexplode(F.split("seq", "")).alias("i", "base")).where("base <> ''")
    return one.select("chrom", (F.col("pos") + F.col("i")).alias("pos"), "allele", "base")


def reverse_complement(seq: Column, rna: bool = False) -> Column:
    return F.translate(F.reverse(F.upper(seq)), "ACGU" if rna else "ACGT", "UGCA" if rna else "TGCA")


def gene_exons(exons: DataFrame, isoforms: DataFrame, samples: list[str]) -> DataFrame:
    """Exon rows of each isoform with its expression per sample."""
    return exons.join(isoforms.unpivot(["isoform"], samples, "sample", "expression"), "isoform")
