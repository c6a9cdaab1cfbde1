"""Projections, filters and predicates on variants, results and matrices."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}
_CONDITION = re.compile(r"^\s*(\S+?)\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*$")


def variant_type(ref: Column, alt: Column) -> Column:
    """SNP, indel (reference longer), insert (alternative longer), else NA."""
    a, b = F.length(ref), F.length(alt)
    return F.when((a == 1) & (b == 1), "SNP").when(a > b, "indel").when(a < b, "insert").otherwise("NA")


def vcf_filter(df: DataFrame, expression: str, info: str | None = None, every: bool = True, samples: str | None = None) -> DataFrame:
    """Rows that pass filters such as ``DP >= 20 && TYPE == SNP || QUAL > 30``.

    ``||`` separates filters, ``&&`` conditions of one. Names are columns, ``TYPE``, keys of the map column
    ``info``, or FORMAT keys in the last of ``samples`` (array of structs with a map ``values``, as ``read_vcf``
    makes it; of several numbers the last counts). A missing value fails its condition; a name that no row has
    passes. ``every``: a row needs all filters, else one.
    """
    columns = {c.lower(): c for c in df.columns}
    maps = ([F.col(info)] if info else []) + ([F.element_at(F.col(samples), -1)["values"]] if samples else [])

    def condition(text: str) -> Column:
        m = _CONDITION.match(text)
        if not m:
            raise ValueError(f"not a condition: {text}")
        name, op, value = m.groups()
        value = value.strip("'\"")
        if name.upper() == "TYPE":
            left = variant_type(F.col(columns["ref"]), F.col(columns["alt"]))
        elif name.lower() in columns:
            left = F.col(columns[name.lower()])
        else:
            known = next((m for m in maps if not df.where(F.map_contains_key(m, F.lit(name))).isEmpty()), None)
            if known is None:
                return F.lit(True)
            left = F.element_at(known, name)
            if samples and known is maps[-1]:
                left = F.substring_index(left, ",", -1)
        number = re.fullmatch(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", value)
        left = left.try_cast("double") if number else left.cast("string")
        return F.coalesce(_OPS[op](left, F.lit(float(value) if number else value)), F.lit(False))

    filters = [reduce(lambda a, b: a & b, map(condition, f.split("&&"))) for f in expression.split("||")]
    return df.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), filters))


def spread_filter(df: DataFrame, column: str, width: float = 2.0, least: int = 10) -> DataFrame:
    """Rows strictly within mean +/- ``width`` sample deviations, if there are ``least`` rows; else all.

    One aggregate row is joined back, so no window gathers the table. Null values fail.
    """
    s = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"), F.count(F.lit(1)).alias("_n"))
    near = F.abs(F.col(column) - F.col("_m")) < width * F.col("_s")
    return df.join(F.broadcast(s), F.lit(True)).where((F.col("_n") < least) | near).drop("_m", "_s", "_n")


def vcf_select(df: DataFrame, fields: list[str], info: str, ann: dict[str, int] | None = None) -> DataFrame:
    """Columns, keys of the map ``info`` (missing: ``NA``) and sub-fields of its ``ANN`` by place."""
    def one(name: str) -> Column:
        if name in df.columns:
            return F.col(name)
        if ann and name in ann:
            return F.coalesce(F.get(F.split(F.element_at(F.col(info), "ANN"), r"\|"), F.lit(ann[name])), F.lit("NA")).alias(name)
        return F.coalesce(F.element_at(F.col(info), name), F.lit("NA")).alias(name)

    return df.select(*map(one, fields))


def direction(fc: Column, padj: Column, fc_limit: float, p_limit: float) -> Column:
    """Up, Down or NS (also for nulls)."""
    hit = padj < p_limit
    return F.when(hit & (fc > fc_limit), "Up").when(hit & (fc < -fc_limit), "Down").otherwise("NS")


def classify_deg(df: DataFrame, fc_limit: float = 1.0, p_limit: float = 0.05, fc: str = "log2FoldChange", padj: str = "padj") -> DataFrame:
    return df.withColumn("regulation", direction(F.col(fc), F.col(padj), fc_limit, p_limit))


def split_up_down(df: DataFrame, fc_limit: float = 1.0, p_limit: float = 0.05) -> tuple[DataFrame, DataFrame]:
    named = classify_deg(df, fc_limit, p_limit)
    return tuple(named.where(F.col("regulation") == k).drop("regulation") for k in ("Up", "Down"))


def low_count_filter(m: DataFrame, least: float, samples: int, rule: str = "half") -> DataFrame:
    """Features with enough samples of at least ``least``: ``half`` (>= n / 2), ``over_half`` (> n / 2) or ``three`` (> least in 3)."""
    value = F.col("value") > least if rule == "three" else F.col("value") >= least
    n = F.count_if(value)
    keep = {"half": n >= samples / 2, "over_half": n > samples / 2, "three": n >= 3}[rule]
    good = m.groupBy("feature").agg(keep.alias("_k")).where("_k").select("feature")
    return m.join(good, "feature", "left_semi")


def drop_all_zero(m: DataFrame) -> DataFrame:
    return m.join(m.groupBy("feature").agg(F.max(F.abs("value")).alias("_v")).where("_v > 0").select("feature"), "feature", "left_semi")


def zero_fraction_filter(m: DataFrame, samples: int, limit: float = 0.25) -> DataFrame:
    """Features whose share of zeros (absent cells count) is at most ``limit``."""
    good = m.groupBy("feature").agg((1 - F.count_if(F.col("value") != 0) / samples).alias("_z")).where(F.col("_z") <= limit).select("feature")
    return m.join(good, "feature", "left_semi")


def coverage_percentile_filter(df: DataFrame, depth: str, low: float = 10, high: float = 99.9) -> DataFrame:
    """Per sample, drop rows under ``low`` or over the ``high`` percentile of depth."""
    top = df.groupBy("sample").agg(F.percentile(depth, high / 100).alias("_top"))
    return df.join(top, "sample").where((F.col(depth) >= low) & (F.col(depth) <= F.col("_top"))).drop("_top")


def tf_bound_genes(sea: DataFrame, hits: DataFrame, peaks: DataFrame, motif: str) -> DataFrame:
    """Distinct genes of peaks whose true, non-holdout hits reach the motif's score threshold."""
    limit = F.broadcast(sea.where(F.col("alt_id") == motif).groupBy("alt_id").agg(F.max("score_thr").alias("limit")))
    good = hits.where((F.col("motif") == motif) & (F.col("seq_class") == "tp") & ~F.col("holdout")).join(limit, F.col("motif") == F.col("alt_id"))
    good = good.where("score >= limit").select("peak_id")
    return peaks.join(good, "peak_id", "left_semi").select("gene").distinct()


def keyword_prefilter(terms: DataFrame, notes: DataFrame, stopwords: list[str]) -> DataFrame:
    """Terms that share a word, not a stop word, with any note."""
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+")))
    said = notes.select(words("text").alias("word")).where(~F.col("word").isin("", *stopwords)).distinct()
    found = terms.select("term", words("term").alias("word")).join(said, "word", "left_semi").select("term").distinct()
    return terms.join(found, "term", "left_semi")


def clip(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high))))


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Spaces become ``_``."""
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def regulation_labels(genes: DataFrame, tables: dict[str, DataFrame], p_limit: float = 0.05) -> DataFrame:
    """Per comparison Upreg, Downreg or Ns of each gene; genes that are Ns everywhere go."""
    out = genes
    for name, t in tables.items():
        label = F.when(F.col("padj") >= p_limit, "Ns").when(F.col("log2FoldChange") > 0, "Upreg").when(F.col("log2FoldChange") < 0, "Downreg").otherwise("Ns")
        out = out.join(t.select("gene_symbol", F.when(F.col("padj").isNull(), "Ns").otherwise(label).alias(name)), "gene_symbol", "left").fillna("Ns", [name])
    return out.where(reduce(lambda a, b: a | b, [F.col(n) != "Ns" for n in tables]))


def resolve_gene_list(genes: DataFrame, matrix: DataFrame) -> DataFrame:
    """Distinct matrix rows (gene_id, gene_symbol) named by id or symbol, versions ignored; a missing name copies the other."""
    bare = genes.select(F.substring_index("gene", ".", 1).alias("gene")).distinct()
    rows = matrix.select(F.coalesce("gene_id", "gene_symbol").alias("gene_id"), F.coalesce("gene_symbol", "gene_id").alias("gene_symbol")).distinct()
    by_id = rows.join(bare, F.substring_index("gene_id", ".", 1) == F.col("gene"), "left_semi")
    by_symbol = rows.join(bare, F.col("gene_symbol") == F.col("gene"), "left_semi")
    return by_id.union(by_symbol).distinct()


def filter_gene_sets(sets: DataFrame, wanted: list[str], excluded: list[str] = ()) -> DataFrame:
    """Sets by category, subcategory or name, without excluded subcategories."""
    hit = F.col("category").isin(wanted) | F.col("subcategory").isin(wanted) | F.col("name").isin(wanted)
    return sets.where(hit & ~F.coalesce(F.col("subcategory").isin(list(excluded)), F.lit(False)))


def peaks_of_interest(peaks: DataFrame, genes: DataFrame, p_limit: float = 0.05) -> DataFrame:
    return peaks.where(F.col("padj") < p_limit).join(genes.select("gene_symbol").distinct(), "gene_symbol", "left_semi")
