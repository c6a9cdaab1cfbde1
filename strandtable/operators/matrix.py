"""Normalisation of long matrices (feature, sample, value). Absent cells are zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log2


def _to_median_total(m: DataFrame) -> DataFrame:
    totals = m.groupBy("sample").agg(F.sum("value").alias("_t"))
    middle = totals.agg(F.median("_t").alias("_m"))
    sized = totals.join(F.broadcast(middle), F.lit(True))
    return m.join(sized, "sample").withColumn("value", F.when(F.col("_t") != 0, F.col("value") * F.col("_m") / F.col("_t")).otherwise(0.0)).drop("_t", "_m")


def pf_log1p_pf(m: DataFrame) -> DataFrame:
    """Scale to the median library size, log1p, scale again."""
    return _to_median_total(_to_median_total(m).withColumn("value", F.log1p("value")))


def complete(m: DataFrame, fill: float = 0.0) -> DataFrame:
    """All feature and sample pairs: features times the small set of samples."""
    grid = m.select("feature").distinct().crossJoin(m.select("sample").distinct())
    return grid.join(m, ["feature", "sample"], "left").fillna(fill, ["value"])


def size_factors(m: DataFrame) -> DataFrame:
    """Median over features of the ratio to the geometric mean; zeros count as 1."""
    full = complete(m).withColumn("value", F.when(F.col("value") <= 0, 1.0).otherwise(F.col("value")))
    means = full.groupBy("feature").agg(F.avg(F.log("value")).alias("_g"))
    return full.join(means, "feature").groupBy("sample").agg(F.median(F.col("value") / F.exp("_g")).alias("size_factor"))


def median_of_ratios(m: DataFrame) -> DataFrame:
    return m.join(size_factors(m), "sample").select("feature", "sample", (F.col("value") / F.col("size_factor")).alias("value"))


def cpm_log1p(m: DataFrame) -> DataFrame:
    t = m.groupBy("sample").agg(F.sum("value").alias("_t"))
    return m.join(t, "sample").select("feature", "sample", F.log1p(F.col("value") * 1e6 / F.col("_t")).alias("value"))


def tpm(m: DataFrame, spans: DataFrame) -> DataFrame:
    """Per million of reads per base; a gene's length is its span, 1 where unknown or 0."""
    rate = m.join(spans, "feature", "left").withColumn("r", F.col("value") / F.greatest(F.coalesce("length", F.lit(1)), F.lit(1)))
    t = rate.groupBy("sample").agg(F.sum("r").alias("_t"))
    return rate.join(t, "sample").select("feature", "sample", (F.col("r") * 1e6 / F.col("_t")).alias("value"))


def zscore_rows(m: DataFrame) -> DataFrame:
    """(x - mean) / sample deviation per feature; 0 where there is no spread."""
    s = m.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return m.join(s, "feature").select("feature", "sample", z.alias("value"))


def rescale_profile(m: DataFrame, percent: bool = False) -> DataFrame:
    """Counts to the median total, or to 100 per sample."""
    if not percent:
        return _to_median_total(m)
    t = m.groupBy("sample").agg(F.sum("value").alias("_t"))
    return m.join(t, "sample").withColumn("value", F.col("value") * 100 / F.col("_t")).drop("_t")


def median_coverage_normalize(df: DataFrame, depth: str) -> DataFrame:
    """Scale each sample's depth so that medians equal the median of medians."""
    per = df.groupBy("sample").agg(F.median(depth).alias("_m"))
    all_ = per.agg(F.median("_m").alias("_all"))
    return df.join(per.join(F.broadcast(all_), F.lit(True)), "sample").withColumn(depth, F.col(depth) * F.col("_all") / F.col("_m")).drop("_m", "_all")


def triwise_coords(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Three log2 changes as a point in the plane: x, y, angle, radius; rows of zeros go."""
    lin = [F.pow(F.lit(2.0), F.col(k)) for k in (a, b, c)]
    mean = (lin[0] + lin[1] + lin[2]) / 3
    d = [v - mean for v in lin]
    root = 3**0.5 / 2
    out = df.where(" or ".join(f"{k} <> 0" for k in (a, b, c))).withColumns({"x": d[0] - 0.5 * d[1] - 0.5 * d[2], "y": root * d[1] - root * d[2]})
    return out.withColumns({"angle": F.atan2("y", "x"), "radius": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)})


def log_stabilize(m: DataFrame) -> DataFrame:
    """log2(count / size factor + 1)."""
    return m.join(size_factors(m), "sample").select("feature", "sample", log2(F.col("value") / F.col("size_factor") + 1).alias("value"))


def batch_adjust(m: DataFrame, sheet: DataFrame) -> DataFrame:
    """Centre each feature's batches on its overall mean, on the log scale, if every batch has over one sample."""
    if sheet.groupBy("batch").agg(F.countDistinct("sample").alias("n")).where("n < 2").limit(1).count():
        return m
    logs = m.join(sheet.select("sample", "batch"), "sample").withColumn("l", F.log1p("value"))
    overall = logs.groupBy("feature").agg(F.avg("l").alias("_o"))
    within = logs.groupBy("feature", "batch").agg(F.avg("l").alias("_w"))
    fixed = F.greatest(F.expm1(F.col("l") - F.col("_w") + F.col("_o")), F.lit(0.0))
    return logs.join(overall, "feature").join(within, ["feature", "batch"]).select("feature", "sample", fixed.alias("value"))
