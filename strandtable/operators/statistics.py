"""Hypothesis tests and models on grouped rows; p-values are Columns on the aggregated rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import chi2_sf, erfc, fisher_two_sided, hypergeometric_sf, log2, normal_two_sided, t_two_sided
from ..functions.permute import drawn, permuted
from ..functions.ranking import across_pieces, average_ranks, join_on_keys, row_places, sum_below, with_piece
from ..functions.storage import settle
from . import filters, matrix


def bh_fdr(df: DataFrame, p: str = "pvalue", by: list[str] = (), out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg; null p-values stay null.

    Only distinct p-values go through windows, cut into pieces, so neither all of them nor a large group
    of ``by`` is one task.
    """
    keys = list(by)
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n"))
    rows = with_piece(counts, p)
    w = Window.partitionBy(*keys, "_piece").orderBy(p)
    zero = F.lit(0)
    rows = across_pieces(rows, keys, {"_b": ("sum", F.sum("_n"))}).withColumn("_r", F.coalesce("_b", zero) + F.sum("_n").over(w))
    rows = rows.withColumn("_q", F.col(p) * (F.coalesce("_b", zero) + F.col("_b_own") + F.coalesce("_b_later", zero)) / F.col("_r"))
    rows = across_pieces(rows.select(*keys, "_piece", p, "_q"), keys, {"_m": ("min", F.min("_q"))})
    step = F.least(F.lit(1.0), F.min("_q").over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("_m_later"))
    step = rows.withColumn(out, step).select(*keys, F.col(p).alias("_p"), out)
    on = F.col(p) == F.col("_p")
    for k in keys:
        step = step.withColumnRenamed(k, f"_by_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    return df.join(step, on, "left").drop("_p", *[f"_by_{k}" for k in keys])


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: str, first: str, few_keys: bool = False) -> DataFrame:
    """Rank-sum test per key: U of group ``first``, tie-corrected two-sided normal p with continuity.

    Equal values are counted before ranking, so a window sees one row per key, value. ``few_keys`` cuts
    the values of a key into pieces, for keys that hold a large part of all rows.
    """
    v = df.groupBy(*keys, value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) != first).alias("b"))
    t = F.col("a") + F.col("b")
    v = v.where(F.col(value).isNotNull()).withColumn("t", t)
    if few_keys:
        v = sum_below(v, keys, value, "t", "below")
    else:
        v = v.withColumn("below", F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    v = v.withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    s = v.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n, n1, n2 = F.col("n1") + F.col("n2"), F.col("n1"), F.col("n2")
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.when((n1 > 0) & (n2 > 0) & (sd > 0), F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd)
    return s.withColumn("z", z).withColumn("pvalue", normal_two_sided(F.col("z"))).select(*keys, "n1", "n2", "u", "z", "pvalue")


def kruskal_wallis(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Rank test of any number of groups per key: tie-corrected H and its chi-square p; null for one group or no spread."""
    ranked = average_ranks(df.where(F.col(group).isNotNull()), keys, value, "_rank")
    ties = ranked.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("t")).groupBy(*keys).agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    s = ranked.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.sum("_rank").alias("r"))
    s = s.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("r") ** 2 / F.col("n")).alias("q"), (F.count(F.lit(1)) - 1).alias("df"))
    n = F.col("n").cast("double")
    even = F.when(n > 1, 1 - F.try_divide(F.col("ties"), n**3 - n)).otherwise(0.0)
    s = join_on_keys(s, ties, keys).withColumn("h", F.when((F.col("df") > 0) & (even > 0), (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / even))
    return s.withColumn("pvalue", chi2_sf(F.col("h"), F.col("df"))).select(*keys, "n", "df", "h", "pvalue")


def signed_rank(df: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """Wilcoxon signed-rank test per key; zero differences go, ties are corrected."""
    d = df.where(F.col(difference) != 0).groupBy(*keys, F.abs(difference).alias("m")).agg(F.count_if(F.col(difference) > 0).alias("a"), F.count(F.lit(1)).alias("t"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = d.withColumn("rank", below + (F.col("t") + 1) / 2).groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("a") * F.col("rank")).alias("w"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(sd > 0, (F.col("w") - n * (n + 1) / 4) / sd)
    return s.withColumn("z", z).withColumn("pvalue", normal_two_sided(F.col("z"))).select(*keys, "n", "w", "z", "pvalue")


def rank_sum_methylation(calls: DataFrame, groups: DataFrame, one: str, two: str, keys: list[str], pseudo: float = 1e-6) -> DataFrame:
    """Rank-sum test of the samples' methylation at each place (calls: keys, sample, value): means, log2 of their ratio, u, p, BH.

    ``pseudo`` is added to both means before the ratio. Values are those of samples, a row each, so a place is a few rows.
    """
    rows = calls.join(groups.where(F.col("condition").isin(one, two)).select("sample", "condition"), "sample").where("value is not null")
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("value")))
    means = rows.groupBy(*keys).agg(mean(one).alias("mean_1"), mean(two).alias("mean_2"))
    change = log2((F.col("mean_2") + pseudo) / (F.col("mean_1") + pseudo))
    tested = mann_whitney(rows, keys, "value", "condition", one).select(*keys, "n1", "n2", "u", "pvalue")
    return bh_fdr(settle(join_on_keys(means.withColumn("log2_change", change), tested, keys)))


def chi_square_gof(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Goodness of fit of category counts (n) to other counts, rescaled to the same total."""
    both = observed.select(key, F.col("n").alias("o")).join(expected.select(key, F.col("n").alias("e0")), key, "full_outer").fillna(0, ["o", "e0"])
    totals = both.agg(F.sum("o").alias("_o"), F.sum("e0").alias("_e"))
    both = both.join(F.broadcast(totals), F.lit(True)).withColumn("e", F.col("e0") * F.col("_o") / F.col("_e")).where("e > 0")
    s = both.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))
    return s.withColumn("pvalue", chi2_sf(F.col("chi2"), F.col("df")))


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str, two_sided: bool = False) -> DataFrame:
    """Fisher's exact test of the table [[a, b], [c, d]] in each row."""
    n, marked, drawn = F.col(a) + F.col(b) + F.col(c) + F.col(d), F.col(a) + F.col(c), F.col(a) + F.col(b)
    f = fisher_two_sided if two_sided else hypergeometric_sf
    return df.withColumn("pvalue", f(F.col(a), n, marked, drawn))


def overrepresentation(genes: DataFrame, t2g: DataFrame, least: int = 10, most: int = 500, two_sided: bool = False, background: DataFrame | None = None) -> DataFrame:
    """Hits of a gene list in each category against the universe of list and sets, or of a ``background`` of genes.

    With a background, genes outside it count neither in the list nor in the sets. One semi join marks the hits and
    one grouping counts them; tests run on category rows.
    """
    listed = genes.where("gene_symbol is not null").select("gene_symbol").distinct()
    sets = t2g.where("gene_symbol is not null").select("category", "gene_symbol").distinct()
    if background is not None:
        known = background.where("gene_symbol is not null").select("gene_symbol").distinct()
        listed, sets = (x.join(known, "gene_symbol", "left_semi") for x in (listed, sets.select("category", "gene_symbol")))
        sets = sets.select("category", "gene_symbol")
    universe = known.agg(F.count(F.lit(1)).alias("population")) if background is not None else listed.union(sets.select("gene_symbol")).distinct().agg(F.count(F.lit(1)).alias("population"))
    drawn = listed.agg(F.count(F.lit(1)).alias("drawn"))
    marked = sets.join(listed.withColumn("hit", F.lit(1)), "gene_symbol", "left")
    rows = marked.groupBy("category").agg(F.count(F.lit(1)).alias("marked"), F.count("hit").alias("hits"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit") == 1, F.col("gene_symbol")))), "/").alias("genes"))
    rows = rows.where(F.col("marked").between(least, most)).join(F.broadcast(universe), F.lit(True)).join(F.broadcast(drawn), F.lit(True))
    expected = F.col("marked") * F.col("drawn") / F.col("population")
    rows = rows.withColumns({"expected": F.bround(expected), "log2ratio": F.when(F.col("hits") > 0, log2(F.col("hits") / expected)).otherwise(float("-inf"))})
    k = (F.col("hits"), F.col("population"), F.col("marked"), F.col("drawn"))
    rows = rows.withColumns({"behavior": F.when(F.col("hits") > expected, "over").when(F.col("hits") < expected, "under").otherwise("as expected"), "pvalue": (fisher_two_sided if two_sided else hypergeometric_sf)(*k)})
    return bh_fdr(settle(rows)).orderBy("padj", "category")


def differential_utest(m: DataFrame, sheet: DataFrame, reference: str, other: str, least: float = 10, ratios: bool = False) -> DataFrame:
    """Low-count filter, normalisation, medians, log2 change, rank test and adjusted p per feature."""
    use = sheet.where(F.col("condition").isin(reference, other)).select("sample", "condition")
    m = matrix.complete(m.join(use.select("sample"), "sample", "left_semi"))
    m = settle(filters.low_count_filter(m, least, use.count(), "over_half"))
    normal = matrix.median_of_ratios(m) if ratios else matrix.pf_log1p_pf(m)
    rows = settle(normal.join(use, "sample").select("feature", "condition", "value"))
    mid = lambda c: F.median(F.when(F.col("condition") == c, F.col("value")))
    s = rows.groupBy("feature").agg(mid(reference).alias("median_ref"), mid(other).alias("median_other"))
    change = log2((F.col("median_other") + 1) / (F.col("median_ref") + 1)) if ratios else F.col("median_other") - F.col("median_ref")
    t = mann_whitney(rows, ["feature"], "value", "condition", other).select("feature", "u", "pvalue")
    return bh_fdr(settle(s.withColumn("log2FoldChange", change).join(t, "feature")))


def nb_two_group_wald(m1: Column, n1: Column, m2: Column, n2: Column) -> tuple[Column, Column]:
    """(coefficient, p) of a two-group negative binomial with log link and dispersion 1."""
    coef = F.log(m2 / m1)
    var = (1 + m1) / (n1 * m1) + (1 + m2) / (n2 * m2)
    return coef, normal_two_sided(coef / F.sqrt(var))


def junction_test(j: DataFrame, groups: DataFrame, one: str, two: str, rank_from: int = 8) -> DataFrame:
    """Per junction, with absent samples as 0: flag what one group has alone, rank test for large groups, else Wald."""
    sizes = groups.groupBy("condition").agg(F.countDistinct("sample").alias("n"))
    n = {r["condition"]: r["n"] for r in sizes.where(F.col("condition").isin(one, two)).collect()}
    keys = ["start", "stop"]
    spots = j.select(*keys).distinct().crossJoin(groups.where(F.col("condition").isin(one, two)).select("sample", "condition"))
    rows = spots.join(j, [*keys, "sample"], "left").fillna(0.0, ["reads"])
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("reads")))
    s = rows.groupBy(*keys).agg(mean(one).alias("mean_1"), mean(two).alias("mean_2"))
    coef, wald = nb_two_group_wald(F.col("mean_1"), F.lit(n.get(one, 0)), F.col("mean_2"), F.lit(n.get(two, 0)))
    kind = F.when((F.col("mean_1") == 0) & (F.col("mean_2") == 0), "absent").when(F.col("mean_2") == 0, "unique_1").when(F.col("mean_1") == 0, "unique_2").otherwise("both")
    s = s.withColumn("kind", kind).withColumn("log2FoldChange", F.when(F.col("kind") == "both", log2(F.col("mean_1") / F.col("mean_2"))))
    if min(n.get(one, 0), n.get(two, 0)) >= rank_from:
        s = s.join(mann_whitney(rows, keys, "reads", "condition", one).select(*keys, F.col("pvalue").alias("_p")), keys).withColumn("pvalue", F.when(F.col("kind") == "both", F.col("_p"))).drop("_p")
    else:
        s = s.withColumn("pvalue", F.when(F.col("kind") == "both", wald))
    return bh_fdr(s)


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Slope, intercept, r and two-sided p."""
    s = df.groupBy(*by) if by else df
    s = s.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_count(y, x).alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") ** 2))
    return s.withColumn("pvalue", F.when((F.col("n") > 2) & (F.abs("r") < 1), t_two_sided(t, F.col("n") - 2)).when(F.abs("r") >= 1, 0.0))


def regression_outliers(df: DataFrame, x: str, y: str, width: float = 2.0) -> DataFrame:
    """Rows whose residual exceeds ``width`` times the slope's standard error times root n."""
    s = df.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"), F.regr_count(y, x).alias("_n"))
    error = F.sqrt((F.col("_syy") - F.col("_sxy") ** 2 / F.col("_sxx")) / (F.col("_n") - 2) / F.col("_sxx"))
    s = s.select("_a", "_b", (width * error * F.sqrt("_n")).alias("_most"))
    out = df.join(F.broadcast(s), F.lit(True)).withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x))
    return out.where(F.abs("residual") > F.col("_most")).drop("_a", "_b", "_most")


def trend_outliers(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Points whose distance from the fit line exceeds 2 population deviations of the distances in their bin along it."""
    s = df.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    p = df.join(F.broadcast(s), F.lit(True))
    foot = (F.col(x) + F.col("_b") * (F.col(y) - F.col("_a"))) / (1 + F.col("_b") ** 2)
    p = p.withColumn("_d", F.abs(F.col(y) - F.col("_a") - F.col("_b") * F.col(x)) / F.sqrt(1 + F.col("_b") ** 2))
    p = p.withColumn("bin", F.floor((foot - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / (bins - 1)))).where(F.col("bin").between(0, bins - 1))
    spread = p.groupBy("bin").agg((2 * F.stddev_pop("_d")).alias("_most"))
    return p.join(spread, "bin").where("_d > _most").withColumnRenamed("_d", "distance").drop("_a", "_b", "_lo", "_hi", "_most")


def pearson_by_category(df: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """r and p overall (label ``all``) and per label."""
    rows = df.select(F.explode(F.array(F.lit("all"), F.col(label))).alias("label"), x, y)
    return linear_fit(rows, x, y, ["label"]).select("label", "n", "r", "pvalue")


# Link, its inverse's slope over the variance (the weight of a row), and whether the spread is estimated, by family.
FAMILIES = {
    "gaussian": (lambda m: m, lambda m: F.lit(1.0), True),
    "poisson": (F.log, lambda m: m, False),
    "binomial": (lambda m: F.log(F.try_divide(m, 1 - m)), lambda m: m * (1 - m), False),
    "gamma": (lambda m: F.try_divide(F.lit(1.0), m), lambda m: m * m, True),
}


def fit_glm(df: DataFrame, responses: list[str], factor: str, family: str = "gaussian") -> DataFrame:
    """A generalised linear model (canonical link) of each response on one factor: response, level, baseline, coefficient, error, pvalue, padj.

    The likeliest means of a model of one factor are the levels' own, so coefficients, errors and normal p-values
    follow in closed form from one aggregation of all responses, for any number of responses and levels. The
    baseline is a response's smallest level; its row, of level ``Intercept``, is the baseline itself. Responses whose values sum to 0 are left
    out; rows without value or level do not count. Without degrees of freedom for the spread, and where a
    link has no finite value, p is null.
    """
    link, weight, spread = FAMILIES[family]
    long = F.explode(F.array(*[F.struct(F.lit(y).alias("response"), F.col(y).cast("double").alias("y")) for y in responses]))
    rows = df.where(F.col(factor).isNotNull()).select(F.col(factor).cast("string").alias("level"), F.col(factor).alias("_order"), long.alias("x")).select("level", "_order", "x.*").where("y is not null")
    levels = rows.groupBy("response", "level").agg(F.min("_order").alias("_order"), F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"), F.sum("y").alias("s"))
    # Pearson's statistic of a level about its mean, in units of the family's variance function.
    unit = {"gaussian": F.lit(1.0), "gamma": F.col("m") * F.col("m")}.get(family, F.lit(1.0))
    levels = settle(levels.withColumn("x2", F.try_divide(F.col("n") * F.col("v"), unit)))
    whole = levels.groupBy("response").agg(F.sum("s").alias("all"), F.sum("x2").alias("x2"), (F.sum("n") - F.count(F.lit(1))).alias("free"), F.min_by(F.struct("level", "n", "m"), "_order").alias("base"))
    scale = F.when(F.col("free") > 0, F.col("w.x2") / F.col("free")) if spread else F.lit(1.0)
    whole = whole.where(F.col("all") != 0).select(F.col("response").alias("_r"), F.struct("x2").alias("w"), "free", "base").withColumn("scale", scale)
    both = levels.join(whole, F.col("response") == F.col("_r"))
    own, base = F.col("level") == F.col("base.level"), F.col("base.m")
    part = lambda n, m: F.try_divide(F.lit(1.0), n * weight(m))
    coefficient = F.when(own, link(base)).otherwise(link(F.col("m")) - link(base))
    error = F.sqrt(F.col("scale") * (part(F.col("base.n"), base) + F.when(own, 0.0).otherwise(part(F.col("n"), F.col("m")))))
    out = both.select("response", F.when(own, "Intercept").otherwise(F.col("level")).alias("level"), F.col("base.level").alias("baseline"), coefficient.alias("coefficient"), error.alias("error"))
    return bh_fdr(settle(out.withColumn("pvalue", F.when(F.col("error") > 0, normal_two_sided(F.col("coefficient") / F.col("error"))))))


def genotype_effect(df: DataFrame, reference: str, p_limit: float = 0.05) -> DataFrame:
    """Per cell type, each genotype against the reference: difference, t-test p, enriched or depleted, medians."""
    v = F.col("value")
    s = df.groupBy("cell_type", "genotype").agg(F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.count(v).alias("n"), F.median(v).alias("median"))
    s = settle(s)
    ref = s.where(F.col("genotype") == reference).select("cell_type", *[F.col(c).alias(f"ref_{c}") for c in ("mean", "var", "n", "median")])
    rows = s.where(F.col("genotype") != reference).join(ref, "cell_type")
    n = F.col("n") + F.col("ref_n")
    pooled = ((F.col("n") - 1) * F.col("var") + (F.col("ref_n") - 1) * F.col("ref_var")) / (n - 2)
    t = (F.col("mean") - F.col("ref_mean")) / F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("ref_n")))
    rows = rows.withColumns({"effect": F.col("mean") - F.col("ref_mean"), "pvalue": F.when((n > 2) & (pooled > 0), t_two_sided(t, n - 2))})
    flag = F.when(F.col("pvalue") < p_limit, F.when(F.col("effect") > 0, "enriched").otherwise("depleted")).otherwise("ns")
    return rows.withColumn("flag", flag).select("cell_type", "genotype", "effect", "pvalue", "flag", "median", "ref_median")


def gene_linear_model(m: DataFrame, sheet: DataFrame, reference: str, other: str) -> DataFrame:
    """Per feature, two-group least squares on the values (an approximation of moderated models): change, t, p, BH."""
    rows = matrix.complete(m).join(sheet.where(F.col("condition").isin(reference, other)), "sample")
    named = rows.select(F.col("feature").alias("cell_type"), F.col("condition").alias("genotype"), "value")
    out = genotype_effect(named, reference).select(F.col("cell_type").alias("feature"), F.col("effect").alias("change"), "pvalue")
    return bh_fdr(settle(out))


def nb_differential(m: DataFrame, sheet: DataFrame, reference: str, other: str) -> DataFrame:
    """Negative binomial test of two conditions (an approximation: moment dispersion, no shrinkage).

    Size factors by median of ratios, Wald test with the pooled moment dispersion, and BH.
    """
    full = settle(matrix.complete(m.join(sheet.where(F.col("condition").isin(reference, other)).select("sample"), "sample", "left_semi")))
    rows = matrix.median_of_ratios(full).join(sheet.select("sample", "condition"), "sample")
    at = lambda f, c: f(F.when(F.col("condition") == c, F.col("value")))
    s = rows.groupBy("feature").agg(*[at(f, c).alias(f"{n}{k}") for k, c in enumerate((reference, other)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    n = F.col("n0") + F.col("n1") - 2
    var = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / n
    mean = (F.col("m0") * F.col("n0") + F.col("m1") * F.col("n1")) / (F.col("n0") + F.col("n1"))
    alpha = F.greatest((var - mean) / mean**2, F.lit(1e-8))
    m0, m1 = F.greatest("m0", F.lit(0.5)), F.greatest("m1", F.lit(0.5))
    se = F.sqrt((1 / m0 + alpha) / F.col("n0") + (1 / m1 + alpha) / F.col("n1"))
    out = s.where(mean > 0).select("feature", mean.alias("base_mean"), log2(m1 / m0).alias("log2FoldChange"), alpha.alias("dispersion"), (F.log(m1 / m0) / se).alias("z"))
    return bh_fdr(settle(out.withColumn("pvalue", normal_two_sided(F.col("z")))))


#: Cells (features times samples) that are fitted at once.
CELLS = 1 << 17


def _polygamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digamma and trigamma of positive numbers: shifted by 8, then the asymptotic series, as in ``functions.numeric``."""
    y, one, two = x + 8, np.zeros_like(x), np.zeros_like(x)
    for k in range(8):
        part = 1 / (x + k)
        one, two = one + part, two + part * part
    q = 1 / (y * y)
    one = np.log(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240))) - one
    return one, 1 / y + q / 2 + q / y * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q / 30))) + two


def _nb_tests(y: np.ndarray, s: np.ndarray, g: np.ndarray, base_mean: np.ndarray, levels: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(b: log mean of each level, e: log of 1 / dispersion, lrt) of many features' counts (a row each), size factors and level numbers; no count is null.

    Every step is a scoring step for each level's mean and a Newton step, of at most 1, for the dispersion. The one mean of the reduced
    model takes scoring steps at the dispersion found.
    """
    def mean_step(b: np.ndarray, y: np.ndarray, s: np.ndarray, r: np.ndarray) -> np.ndarray:
        m = s * np.exp(b)[:, None]
        part = 1 / (1 + m / r)
        u, i = ((y - m) * part).sum(axis=1), (m * part).sum(axis=1)
        return b + np.where(i > 0, np.clip(u / np.where(i > 0, i, 1), -2, 2), 0.0)

    own = [np.flatnonzero(g == k) for k in range(levels)]
    b = np.stack([np.log((y[:, c] / s[c]).sum(axis=1) / max(len(c), 1) + 1e-8) for c in own])
    e = np.zeros(len(y))
    for _ in range(steps):
        r = np.exp(e)[:, None]
        b = np.stack([mean_step(b[k], y[:, c], s[c], r) for k, c in enumerate(own)])
        m = s * np.exp(b[g].T)
        whole, none = _polygamma(y + r), _polygamma(r)
        one = (whole[0] - none[0] + np.log(r / (r + m)) + 1 - (r + y) / (r + m)).sum(axis=1)
        two = (whole[1] - none[1] + 1 / r - 1 / (r + m) - (m - y) / ((r + m) * (r + m))).sum(axis=1)
        r = r[:, 0]
        u, i = r * one, r * one + r * r * two
        e = np.clip(e + np.where(i < 0, np.clip(-u / np.where(i < 0, i, 1), -1, 1), np.sign(u)), -12, 18)
    r, single = np.exp(e)[:, None], np.log(base_mean)
    for _ in range(steps):
        single = mean_step(single, y, s, r)
    full, one = b[g].T, single[:, None]
    gain = np.where(y > 0, y * (full - one), 0.0) - (y + r) * np.log((r + s * np.exp(full)) / (r + s * np.exp(one)))
    return b, e, np.maximum(2 * gain.sum(axis=1), 0.0)


def nb_likelihood_ratio(m: DataFrame, sheet: DataFrame, levels: list[str], steps: int = 40) -> DataFrame:
    """Likelihood-ratio test of a mean for each of two or more conditions against one mean, negative binomial, and BH.

    Counts are compared at size factors by median of ratios. The dispersion is each feature's maximum-likelihood
    one under the full model (not shrunk towards other features) and holds in both models. A feature's cells, one a sample, are
    one array, and tasks fit many features at once (``_nb_tests``). ``log2FoldChange`` is of the last level against the first. Features
    without counts are left out.
    """
    use = sheet.where(F.col("condition").isin(levels)).select("sample", F.array_position(F.array(*map(F.lit, levels)), F.col("condition")).cast("int").alias("g"))
    full = settle(matrix.complete(m.join(use.select("sample"), "sample", "left_semi")))
    sized = F.broadcast(use.join(matrix.size_factors(full), "sample"))
    cell = F.struct("sample", F.col("value").cast("double").alias("y"), F.col("size_factor").alias("s"), (F.col("g") - 1).alias("g"))
    rows = full.join(sized, "sample").groupBy("feature").agg(F.array_sort(F.collect_list(cell)).alias("x"), F.avg(F.col("value") / F.col("size_factor")).alias("base_mean")).where("base_mean > 0")
    rows = rows.select("feature", "base_mean", F.col("x.y").alias("y"), F.col("x.s").alias("s"), F.col("x.g").alias("g"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Features of one batch may have unlike samples only where the matrix has rows twice.
            batch = batch.assign(like=[hash((tuple(s), tuple(g))) for s, g in zip(batch["s"], batch["g"], strict=True)])
            for _, alike in batch.groupby("like"):
                s, g = np.asarray(alike["s"].iloc[0], dtype=float), np.asarray(alike["g"].iloc[0], dtype=int)
                at_once = max(1, CELLS // len(s))
                for at in range(0, len(alike), at_once):
                    part = alike.iloc[at : at + at_once]
                    b, e, lrt = _nb_tests(np.stack(part["y"].to_numpy()), s, g, part["base_mean"].to_numpy(), len(levels), steps)
                    yield pd.DataFrame({"feature": part["feature"], "base_mean": part["base_mean"], "log2FoldChange": (b[-1] - b[0]) / math.log(2), "dispersion": np.exp(-e), "lrt": lrt})

    out = rows.mapInPandas(fit, f"feature {dict(m.dtypes)['feature']}, base_mean double, log2FoldChange double, dispersion double, lrt double")
    return bh_fdr(settle(out.withColumn("pvalue", chi2_sf(F.col("lrt"), F.lit(len(levels) - 1)))))


def diff_methylation(calls: DataFrame, groups: DataFrame, one: str, two: str) -> DataFrame:
    """Per position, binomial deviance test of two groups, scaled by overdispersion where over one: difference in percent, p, q.

    Overdispersion is Pearson's chi-square of the samples against their group's rate, over its degrees of freedom.
    """
    depth = F.col("meth") + F.col("unmeth")
    sums = calls.groupBy("chrom", "pos", "sample").agg(F.sum("meth").cast("double").alias("meth"), F.sum("unmeth").cast("double").alias("unmeth"))
    rows = sums.where(depth > 0).join(groups.where(F.col("condition").isin(one, two)).select("sample", "condition"), "sample").withColumn("square", F.col("meth") ** 2 / depth)
    at = lambda c, k: F.sum(F.when(F.col("condition") == c, F.col(k)).otherwise(0))
    s = rows.groupBy("chrom", "pos").agg(*[at(c, k).alias(f"{n}{i}") for i, c in ((1, one), (2, two)) for k, n in (("meth", "m"), ("unmeth", "u"), ("square", "s"))], F.count(F.lit(1)).alias("k"))
    s = s.where("m1 + u1 > 0 and m2 + u2 > 0")
    ll = lambda m, u: F.when(m > 0, m * F.log(m / (m + u))).otherwise(0.0) + F.when(u > 0, u * F.log(u / (m + u))).otherwise(0.0)
    m1, u1, m2, u2 = (F.col(c) for c in ("m1", "u1", "m2", "u2"))
    deviance = 2 * (ll(m1, u1) + ll(m2, u2) - ll(m1 + m2, u1 + u2))
    pearson = lambda m, u, q: F.when(m * u > 0, (q - m * m / (m + u)) / (m * u / (m + u) ** 2)).otherwise(0.0)
    phi = F.when(F.col("k") > 2, F.greatest((pearson(m1, u1, F.col("s1")) + pearson(m2, u2, F.col("s2"))) / (F.col("k") - 2), F.lit(1.0))).otherwise(1.0)
    s = s.withColumns({"difference": 100 * (m2 / (m2 + u2) - m1 / (m1 + u1)), "deviance": F.greatest(deviance, F.lit(0.0)) / phi})
    return bh_fdr(settle(s.drop("s1", "s2", "k").withColumn("pvalue", F.round(F.least(F.lit(1.0), erfc(F.sqrt(F.col("deviance") / 2))), 12))), out="qvalue")


def gene_signature_score(m: DataFrame, genes: DataFrame, controls: int = 20, bins: int = 50, seed: int = 1) -> DataFrame:
    """Per sample: mean scaled value of the set minus that of controls of like expression (seeded order)."""
    scaled = matrix.zscore_rows(m)
    means = m.groupBy("feature").agg(F.avg("value").alias("mean"))
    cuts = means.agg(F.percentile_approx("mean", [k / bins for k in range(1, bins)], 10000).alias("c"))
    binned = means.join(F.broadcast(cuts), F.lit(True)).select("feature", F.size(F.filter("c", lambda c: c < F.col("mean"))).alias("bin"))
    mine = binned.join(genes.select(F.col("feature")).distinct(), "feature", "left_semi")
    wanted = mine.groupBy("bin").agg((F.count(F.lit(1)) * controls).alias("k"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("feature").cast("string")))
    pool = binned.join(mine.select("feature"), "feature", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy(order)))
    used = pool.join(wanted, "bin").where("r <= k").select("feature", F.lit("control").alias("role")).union(mine.select("feature", F.lit("set")))
    s = scaled.join(used, "feature").groupBy("sample").agg(F.avg(F.when(F.col("role") == "set", F.col("value"))).alias("a"), F.avg(F.when(F.col("role") == "control", F.col("value"))).alias("b"))
    return s.select("sample", (F.col("a") - F.coalesce("b", F.lit(0.0))).alias("score"))


def pairwise_condition_tests(df: DataFrame) -> DataFrame:
    """Every pair of conditions of (condition, value): rank test and BH. Pairs join value counts, not rows."""
    names = df.select("condition").distinct()
    pairs = names.select(F.col("condition").alias("one")).join(names.select(F.col("condition").alias("two")), F.col("one") < F.col("two"))
    rows = df.join(F.broadcast(pairs), (F.col("condition") == F.col("one")) | (F.col("condition") == F.col("two")))
    marked = rows.withColumn("side", F.when(F.col("condition") == F.col("one"), "one").otherwise("two"))
    return bh_fdr(mann_whitney(marked, ["one", "two"], "value", "side", "one", few_keys=True))


def condition_summary(df: DataFrame) -> DataFrame:
    """(condition, n, mean, deviation, q1, median, q3) of (condition, value)."""
    at = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = df.where("value is not null").groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), at.alias("q"))
    return s.select("condition", "n", "mean", "deviation", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def _welch(rows: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """(by, t): Welch's t of the values of side 1 less those of side 0; null without spread or with fewer than two on a side."""
    at = lambda f, c: f(F.when(F.col(side) == c, F.col(value)))
    s = rows.groupBy(*by).agg(*[at(f, c).alias(f"{n}{c}") for c in (0, 1) for n, f in (("a", F.avg), ("v", F.var_samp), ("n", F.count))])
    error = F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))
    return s.select(*by, F.when(error > 0, (F.col("a1") - F.col("a0")) / error).alias("t"))


def nested_resampling_test(df: DataFrame, one: str, two: str, rounds: int = 1000, boots: int = 20, seed: int = 1) -> DataFrame:
    """Welch t of replicate means and its p under a two-level null. Rows: treatment, replicate, value. Returns t, pvalue, rounds.

    Each of ``boots`` times the values of every replicate are drawn anew with replacement, and the treatments are dealt
    out over the replicates: in every possible way if there are at most ``rounds``, else in ``rounds`` seeded ones. p is the
    share of all these t beyond the seen one on either side; a t without spread is beyond none. Replicates are few (a row
    each after averaging); their values are ranked in pieces and drawn by place, so one large replicate is many tasks.
    """
    rows = df.where(F.col("treatment").isin(one, two) & F.col("value").isNotNull()).select("treatment", "replicate", F.col("value").cast("double").alias("value"))
    placed = settle(row_places(rows, [F.col("value"), F.col("treatment")], ["replicate"], "place"))
    means = placed.groupBy("treatment", "replicate").agg(F.avg("value").alias("m")).withColumn("side", (F.col("treatment") == two).cast("int"))
    seen = _welch(means.withColumn("_", F.lit(1)), ["_"], "side", "m").select(F.abs("t").alias("seen"), F.col("t").alias("seen_t"))
    names = [r[0] for r in placed.select("replicate").distinct().orderBy("replicate").collect()]
    firsts = means.where("side = 0").count()
    # Draws: as many places as the replicate has values; how often each place is drawn is counted before it meets its value.
    sizes = placed.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"))
    indexed = df.sparkSession.createDataFrame(list(enumerate(names)), f"index long, _name {dict(rows.dtypes)['replicate']}")
    sizes = F.broadcast(sizes.join(indexed, F.col("replicate").eqNullSafe(F.col("_name"))).drop("_name"))
    draws = join_on_keys(placed.select("replicate", "place"), sizes, ["replicate"]).withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(boots)).cast("array<long>")))
    draws = draws.select("replicate", "index", "n", "boot", drawn(F.col("n"), F.lit(seed).cast("long"), F.col("boot"), F.col("index"), F.col("place")).alias("place"))
    draws = draws.groupBy("replicate", "index", "n", "boot", "place").agg(F.count(F.lit(1)).alias("c"))
    again = join_on_keys(draws, placed.select("replicate", "place", "value"), ["replicate", "place"])
    again = settle(again.groupBy("index", "n", "boot").agg((F.sum(F.col("c") * F.col("value"))).alias("s")).select("index", "boot", (F.col("s") / F.col("n")).alias("m")))
    if math.comb(len(names), firsts) <= rounds:
        deals = [(k, list(some)) for k, some in enumerate(combinations(range(len(names)), firsts))]
        deals = F.broadcast(df.sparkSession.createDataFrame(deals, "round long, firsts array<long>"))
        mixed = again.join(deals, F.lit(True)).withColumn("side", F.when(F.array_contains("firsts", F.col("index")), 0).otherwise(1))
    else:
        mixed = again.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)).cast("array<long>")))
        mixed = mixed.withColumn("side", (permuted(F.col("index"), len(names), F.lit(seed).cast("long"), F.col("round")) >= firsts).cast("int"))
    null = _welch(mixed, ["boot", "round"], "side", "m").join(F.broadcast(seen), F.lit(True))
    return null.groupBy("seen_t").agg(F.avg(F.coalesce((F.abs("t") > F.col("seen")).cast("double"), F.lit(0.0))).alias("pvalue"), F.count(F.lit(1)).alias("rounds")).withColumnRenamed("seen_t", "t")


def _enrichment(hits: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, k, es) of hits (by, k, at from 0, w): the extreme of the running sum. Between hits the sum falls in a straight line, so hits are enough."""
    group = Window.partitionBy(*by)
    order = group.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("w").over(group)
    j = F.row_number().over(group.orderBy("at"))
    # A set without any weight climbs in equal steps.
    share = lambda part, even: F.when(total > 0, part / total).otherwise(even / F.col("k"))
    up, step, miss = share(F.sum("w").over(order), j), share(F.col("w"), F.lit(1)), (F.col("at") + 1 - j) / F.greatest(F.lit(n) - F.col("k"), F.lit(1))
    s = hits.withColumns({"hi": up - miss, "lo": up - step - miss}).groupBy(*by, "k").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    return s.select(*by, "k", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))


#: Ranked places whose weights are one array, and random sets that one call draws from such an array.
PLACES, DRAWS = 1 << 16, 20_000


def _random_enrichment(blocks: DataFrame, n: int, sizes: DataFrame, start: int, stop: int, seed: int) -> DataFrame:
    """(k, es) of a random set of each of ``sizes`` (k) in each round from ``start`` to ``stop``, over blocks (block, w) of ``n`` ranked weights.

    A round draws how many places of the set lie in each block, then which; both follow from the seed, so they can be drawn
    again. Blocks first tell their sums, and once the sums before them are known, the extremes of the running score. So a
    task holds a block, whatever ``n``, and of one block the first pass is all.
    """
    lengths = [min(PLACES, n - at) for at in range(0, n, PLACES)]
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = min(stop - start, max(math.ceil(2 * parts / max(1, len(lengths))), math.ceil(sizes.count() * (stop - start) / DRAWS)))
    tasks = blocks.crossJoin(blocks.sparkSession.range(chunks).withColumnRenamed("id", "chunk"))

    def drawn_places(block: int, k: int, turn: int) -> np.ndarray:
        key = [seed % 2**63, k, turn]
        many = k if len(lengths) == 1 else np.random.Generator(np.random.PCG64(key)).multivariate_hypergeometric(lengths, k)[block]
        held = np.zeros(lengths[block], dtype=bool)
        held[np.random.Generator(np.random.PCG64([*key, block + 1])).choice(lengths[block], many, replace=False, shuffle=False)] = True
        return np.flatnonzero(held)

    def extremes(w: np.ndarray, at: np.ndarray, first: int, k: int, before: int, below: float, total: float) -> tuple[float, float]:
        steps = w[at] / total if total > 0 else np.full(len(at), 1 / k)
        up = (below / total if total > 0 else before / k) + np.cumsum(steps)
        miss = (first + at - before - np.arange(len(at))) / max(n - k, 1)
        return (up - miss).max(), (up - steps - miss).min()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, w, chunk, ks in zip(b["block"], b["w"], b["chunk"], b["sizes"], strict=True):
                rows = []
                for k in map(int, ks):
                    for turn in range(start + chunk, stop, chunks):
                        at = drawn_places(block, k, turn)
                        if len(at):
                            total = w[at].sum()
                            ends = extremes(w, at, 0, k, 0, 0.0, total) if len(lengths) == 1 else (0.0, 0.0)
                            rows.append((k, turn, block, chunk, len(at), total, *ends))
                yield pd.DataFrame(rows, columns=["k", "round", "block", "chunk", "hits", "weight", "hi", "lo"])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, w, *known in zip(b["block"], b["w"], b["k"], b["round"], b["before"], b["below"], b["total"], strict=True):
                rows = [(k, *extremes(w, drawn_places(block, int(k), int(turn)), block * PLACES, k, before, below, total)) for k, turn, before, below, total in zip(*known, strict=True)]
                yield pd.DataFrame({"k": [r[0] for r in rows], "round": known[1], "hi": [r[1] for r in rows], "lo": [r[2] for r in rows]})

    dealt = tasks.crossJoin(sizes.agg(F.collect_set("k").alias("sizes"))).repartition(parts, "block", "chunk")
    found = dealt.mapInPandas(sums, "k long, round long, block long, chunk long, hits long, weight double, hi double, lo double")
    if len(lengths) > 1:
        set_ = Window.partitionBy("k", "round")
        before = set_.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sized = settle(found).withColumns({"before": F.coalesce(F.sum("hits").over(before), F.lit(0)), "below": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "total": F.sum("weight").over(set_)})
        fields = ["k", "round", "before", "below", "total"]
        known = sized.groupBy("block", "chunk").agg(F.collect_list(F.struct(*fields)).alias("x")).select("block", "chunk", *[F.col(f"x.{c}").alias(c) for c in fields])
        again = tasks.join(known, ["block", "chunk"]).repartition(parts, "block", "chunk").select("block", "w", *fields)
        found = again.mapInPandas(ends, "k long, round long, hi double, lo double").groupBy("k", "round").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    return found.select("k", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))


def preranked_gsea(ranks: DataFrame, t2g: DataFrame, least: int = 10, most: int = 1000, rounds: int = 1000, seed: int = 1, most_rounds: int = 100_000, enough: int = 10) -> DataFrame:
    """Running-sum score of each set over genes ranked by ``score``: category, k, es, nes, pvalue, rounds, padj.

    The null of a set are random sets of its size, so sets of one size share theirs: seeded draws from all places, new ones
    each round and size, without a sort, in blocks of places (``_random_enrichment``). p is (beyond + 1) / (of
    the same sign + 1). Sizes that have a set with fewer than ``enough`` rounds beyond it get ten times as many rounds,
    up to ``most_rounds``. Genes without a score are left out; equal scores follow by gene.
    """
    listed = ranks.where("score is not null").select("gene_symbol", "score")
    placed = settle(row_places(listed, [F.col("score").desc(), F.col("gene_symbol")], [], "at").withColumn("w", F.abs("score")))
    n = placed.count()
    sets = settle(t2g.select("category", "gene_symbol").distinct().join(placed, "gene_symbol").select("category", "at", "w"))
    sized = sets.groupBy("category").agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(least, most))
    seen = settle(_enrichment(sets.join(sized, "category"), ["category"], n))
    block = F.floor(F.col("at") / PLACES)
    blocks = settle(placed.groupBy(block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("w")))

    def beyond(open_sets: DataFrame, start: int, stop: int) -> DataFrame:
        """(category, tried, same, over, total) of rounds ``start`` to ``stop``."""
        null = _random_enrichment(blocks, n, open_sets.select("k").distinct(), start, stop, seed).select(F.col("k").alias("_k"), F.col("es").alias("_es"))
        both = open_sets.join(null, (F.col("k") == F.col("_k")) & ((F.col("es") >= 0) == (F.col("_es") >= 0)))
        found = both.groupBy("category").agg(F.count(F.lit(1)).alias("same"), F.count_if(F.abs("_es") >= F.abs("es")).alias("over"), F.sum(F.abs("_es")).alias("total"))
        return open_sets.select("category").join(found, "category", "left").select("category", F.lit(stop - start).alias("tried"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("same", "over", "total")])

    tally, waiting, done = None, seen, 0
    while True:
        upto = min(most_rounds, rounds if not done else done * 10)
        more = beyond(waiting, done, upto)
        tally = settle(more if tally is None else tally.unionByName(more).groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tried", "same", "over", "total")]))
        done = upto
        waiting = settle(seen.join(tally.where((F.col("over") < enough) & (F.col("tried") == done)).select("category"), "category", "left_semi"))
        if done >= most_rounds or waiting.isEmpty():
            break
    p = (F.col("over") + 1) / (F.col("same") + 1)
    out = seen.join(tally, "category").select("category", "k", "es", (F.col("es") / F.try_divide(F.col("total"), F.col("same"))).alias("nes"), p.alias("pvalue"), F.col("tried").alias("rounds"))
    return bh_fdr(settle(out))


def polygenic_score(calls: DataFrame, weights: DataFrame, reference: DataFrame | None = None, least: float = 20) -> DataFrame:
    """Sum of weights over called alleles (sample, chrom, pos, ref, alt, copies, depth) per sample.

    Alleles of equal length are split by base, others skipped. With ``reference`` (chrom, pos, base), unseen
    sites whose reference base is the effect allele count twice.
    """
    good = calls.where((F.col("depth") >= least) & (F.length("ref") == F.length("alt")))
    bases = good.select("sample", "chrom", "copies", "pos", F.posexplode(F.split("alt", "")).alias("i", "base")).where("base <> ''")
    bases = bases.withColumn("pos", F.col("pos") + F.col("i"))
    w = weights.select(F.col("chrom"), F.col("pos"), F.col("effect_allele").alias("base"), F.col("effect_weight").cast("double").alias("weight"))
    score = bases.join(w, ["chrom", "pos", "base"]).groupBy("sample").agg(F.sum(F.col("weight") * F.col("copies")).alias("score"), F.count(F.lit(1)).alias("alleles"))
    score = calls.select("sample").distinct().join(score, "sample", "left").fillna(0, ["score", "alleles"])
    if reference is None:
        return score
    ref = w.join(reference, ["chrom", "pos", "base"]).select("chrom", "pos", "weight")
    whole = ref.agg(F.coalesce(F.sum(2 * F.col("weight")), F.lit(0.0)).alias("_all"))
    seen = ref.join(good.select("sample", "chrom", "pos").distinct(), ["chrom", "pos"]).groupBy("sample").agg(F.sum(2 * F.col("weight")).alias("_seen"))
    out = score.join(seen, "sample", "left").join(F.broadcast(whole), F.lit(True))
    return out.select("sample", (F.col("score") + F.col("_all") - F.coalesce("_seen", F.lit(0.0))).alias("score"), "alleles")


def model_eval_cv(df: DataFrame, features: list[str], label: str, key: str, estimator, folds: int = 5, seed: int = 1) -> DataFrame:
    """Train and test accuracy (overall and per class) or MSE of a Spark ML estimator over seeded folds."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.withColumn("label", F.col(label).cast("double")))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds))).select("features", "label", "fold")
    out = []
    for k in range(folds):
        model = estimator.fit(rows.where(F.col("fold") != k))
        scored = model.transform(rows).withColumn("part", F.when(F.col("fold") == k, "test").otherwise("train"))
        right = (F.col("prediction") == F.col("label")).cast("double")
        out.append(scored.groupBy("part").agg(F.avg((F.col("prediction") - F.col("label")) ** 2).alias("mse"), F.avg(right).alias("accuracy"), F.avg(F.when(F.col("label") == 0, right)).alias("accuracy_0"), F.avg(F.when(F.col("label") == 1, right)).alias("accuracy_1")).withColumn("fold", F.lit(k)))
    return reduce(DataFrame.unionByName, out)


def classifiers(seed: int = 1) -> dict:
    """Spark ML's families of binary classifiers by name."""
    from pyspark.ml import classification as C

    return {"logistic": C.LogisticRegression(), "linear_svm": C.LinearSVC(), "tree": C.DecisionTreeClassifier(seed=seed), "forest": C.RandomForestClassifier(seed=seed), "boosted": C.GBTClassifier(seed=seed), "naive_bayes": C.NaiveBayes(modelType="gaussian")}


def regressors(seed: int = 1) -> dict:
    """Spark ML's families of regressors by name."""
    from pyspark.ml import regression as R

    return {
        "linear": R.LinearRegression(), "ridge": R.LinearRegression(regParam=1.0), "lasso": R.LinearRegression(regParam=1.0, elasticNetParam=1.0), "elastic": R.LinearRegression(regParam=1.0, elasticNetParam=0.5),
        "tree": R.DecisionTreeRegressor(seed=seed), "forest": R.RandomForestRegressor(seed=seed), "boosted": R.GBTRegressor(seed=seed),
    }


def stratified_splits(df: DataFrame, label: str, key: str, rounds: int = 10, share: float = 0.2, seed: int = 1) -> DataFrame:
    """Add ``tested``: for each round, whether the row is held out; in every round ``share`` of each label's rows are, drawn anew.

    A row's place in its label comes from ranges of a seeded order; a round's draw is a keyed permutation of the places, so no
    round sorts or shuffles. Labels are few: a row each reaches the driver.
    """
    rows = row_places(df.where(F.col(label).isNotNull()), [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)], [label], "_place")
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}

    def held(r: Column) -> Column:
        out = F.lit(False)
        for value, n in sizes.items():
            out = F.when(F.col(label) == value, permuted(F.col("_place"), n, F.lit(seed).cast("long"), r) < round(share * n)).otherwise(out)
        return out

    return rows.withColumn("tested", F.transform(F.sequence(F.lit(1), F.lit(rounds)).cast("array<long>"), held)).drop("_place")


def model_eval_splits(df: DataFrame, features: list[str], label: str, key: str, models: dict, rounds: int = 10, binary: bool = True, seed: int = 1) -> DataFrame:
    """(model, round, part, n, mse, r2, accuracy, accuracy_0, accuracy_1) of Spark ML estimators by name, on train and test parts.

    Binary labels are split by ``stratified_splits`` (a fifth is tested), others into ``rounds`` seeded folds. Accuracies are
    null unless ``binary``.
    """
    from pyspark.ml.feature import VectorAssembler

    if binary:
        rows = stratified_splits(df, label, key, rounds, seed=seed)
    else:
        rows = df.where(F.col(label).isNotNull()).withColumn("tested", F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)).cast("array<long>"), lambda r: F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(rounds)) == r))
    rows = settle(rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"), "tested").dropna(subset=features))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    out = []
    for name, model in models.items():
        for k in range(rounds):
            fitted = model.fit(rows.where(~F.col("tested")[k]).select("features", "label"))
            told = fitted.transform(rows.select("features", "label", F.when(F.col("tested")[k], "test").otherwise("train").alias("part")))
            right = (F.col("prediction") == F.col("label")).cast("double")
            error = F.avg((F.col("prediction") - F.col("label")) ** 2)
            hits = [F.avg(F.when(F.lit(binary) & c, right)).alias(n) for n, c in (("accuracy", F.lit(True)), ("accuracy_0", F.col("label") == 0), ("accuracy_1", F.col("label") == 1))]
            s = told.groupBy("part").agg(F.count(F.lit(1)).alias("n"), error.alias("mse"), (1 - F.try_divide(error, F.var_pop("label"))).alias("r2"), *hits)
            out.append(s.select(F.lit(name).alias("model"), F.lit(k + 1).alias("round"), "*"))
    return reduce(DataFrame.unionByName, out)


def label_encode(df: DataFrame, label: str) -> DataFrame:
    """Sorted labels become 0 .. k - 1 in ``code``; null stays null."""
    codes = df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("code", F.dense_rank().over(Window.orderBy(label)) - 1)
    return df.join(codes, label, "left")
