"""Queries of hypothesis tests and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import sql_erfc
from ..operators import matrix as N
from ..operators import statistics as T
from .registry import query, r6
from .summaries import _PF
from .summaries import _SF as _FACTORS


def _p(z: str) -> str:
    return f"least(1.0, {sql_erfc(f'abs({z})/sqrt(2)')})"


def _bh(p: str = "pvalue", by: str = "") -> str:
    """A window expression: rows must be ranked by ties as one."""
    part = f"PARTITION BY {by}" if by else ""
    return f"least(1.0, min({p} * n_all / n_le) OVER ({part} ORDER BY {p} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def _t_tail(h: str, df: str) -> str:
    """Two-sided tail of Student's t at ``df`` whole degrees of freedom, for the angle ``h`` = atan(|t| / sqrt(df))."""
    even = f"sin({h}) * list_sum([exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow(cos({h}), 2 * j) FOR j IN range(CAST({df} // 2 AS BIGINT))])"
    odd = f"2 / pi() * ({h} + sin({h}) * cos({h}) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * pow(cos({h}), 2 * j) FOR j IN range(CAST(({df} - 1) // 2 AS BIGINT))]), 0))"
    return f"greatest(0.0, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


_RANKED = "count(*) OVER (ORDER BY pvalue RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_le, count(*) OVER () AS n_all"


def _mw(rows: str, keys: str, first: str) -> str:
    """Mann-Whitney over rows(keys, value, g)."""
    return f"""SELECT {keys}, n1, n2, u, z, {_p('z')} AS pvalue FROM (SELECT *, greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / nullif(sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 0) AS z
FROM (SELECT {keys}, sum(a) AS n1, sum(b) AS n2, sum(a * rk) - sum(a) * (sum(a) + 1) / 2.0 AS u, sum(t * t * t - t) AS ties
FROM (SELECT *, a + b AS t, coalesce(sum(a + b) OVER (PARTITION BY {keys} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (a + b + 1) / 2.0 AS rk
FROM (SELECT {keys}, value, count(*) FILTER (WHERE g = '{first}') AS a, count(*) FILTER (WHERE g <> '{first}') AS b FROM ({rows}) GROUP BY {keys}, value)) GROUP BY {keys}))"""


@query("t1_mann_whitney", "SELECT feature, n1, n2, u, round(z, 6) AS z, round(pvalue, 6) AS pvalue FROM (" + _mw("SELECT feature, value, condition AS g FROM counts JOIN sheet USING (sample)", "feature", "A") + ")", "counts sheet")
def _(v):
    t = T.mann_whitney(v("counts").join(v("sheet"), "sample"), ["feature"], "value", "condition", "A")
    return t.withColumns({"z": r6("z"), "pvalue": r6("pvalue")})


@query("t2_signed_rank", f"""SELECT feature, n, w, round(z, 6) + 0.0 AS z, round({_p('z')}, 6) AS pvalue FROM (SELECT *, (w - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 0) AS z FROM (SELECT feature, sum(t) AS n, sum(a * rk) AS w, sum(t * t * t - t) AS ties
FROM (SELECT *, coalesce(sum(t) OVER (PARTITION BY feature ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rk FROM (SELECT feature, abs(value - 50) AS m, count(*) FILTER (WHERE value > 50) AS a, count(*) AS t FROM counts WHERE value <> 50 GROUP BY 1, 2)) GROUP BY feature))""", "counts")
def _(v):
    t = T.signed_rank(v("counts").withColumn("d", F.col("value") - 50), ["feature"], "d")
    return t.withColumns({"z": r6("z"), "pvalue": r6("pvalue")})


# Upper tail of chi-square of x at df whole degrees of freedom.
_CHI_TAIL = f"least(1.0, CASE WHEN df % 2 = 1 THEN {sql_erfc('sqrt(x / 2)')} ELSE 0 END + coalesce(list_sum([exp(-x / 2 + (i + df % 2 / 2) * ln(x / 2) - lgamma(i + 1 + df % 2 / 2)) FOR i IN range(CAST(df // 2 AS BIGINT))]), 0))"


@query("t3_chi_square_gof", f"""SELECT round(x, 6) AS chi2, df, round({_CHI_TAIL}, 6) AS pvalue FROM (SELECT sum((o - e) ** 2 / e) AS x, count(*) - 1 AS df FROM (SELECT coalesce(o, 0) AS o, k * sum(coalesce(o, 0)) OVER () / sum(k) OVER () AS e FROM (SELECT p_container AS key, count(*) AS k FROM part GROUP BY 1) FULL JOIN (SELECT p_container AS key, count(*) AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) USING (key)))""".replace("p_container", "p_type"))
def _(v):
    n = F.count(F.lit(1)).alias("n")
    part = v("part").groupBy(F.col("p_type").alias("key"))
    sold = v("lineitem").join(v("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("key"))
    return T.chi_square_gof(sold.agg(n), part.agg(n), "key").withColumns({"chi2": r6("chi2"), "pvalue": r6("pvalue")})


_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_SF = "least(1.0, list_sum([exp(" + _LC.format("marked", "i") + " + " + _LC.format("(population - marked)", "(drawn - i)") + " - " + _LC.format("population", "drawn") + ") FOR i IN range(greatest(hits, drawn + marked - population, 0), least(marked, drawn) + 1)]))"


@query("t4_fisher_exact", f"SELECT clade, hits AS a, round({_SF}, 6) AS pvalue FROM (SELECT *, a AS hits, a + b + c + d AS population, a + c AS marked, a + b AS drawn FROM (SELECT clade, count(*) FILTER (WHERE sample < 6 AND value > 100) AS a, count(*) FILTER (WHERE sample < 6 AND value <= 100) AS b, count(*) FILTER (WHERE sample >= 6 AND value > 100) AS c, count(*) FILTER (WHERE sample >= 6 AND value <= 100) AS d FROM profile GROUP BY clade))", "profile")
def _(v):
    c = lambda w: F.count_if(F.expr(w))
    t = v("profile").groupBy("clade").agg(c("sample < 6 and value > 100").alias("a"), c("sample < 6 and value <= 100").alias("b"), c("sample >= 6 and value > 100").alias("c"), c("sample >= 6 and value <= 100").alias("d"))
    return T.fisher_exact(t, "a", "b", "c", "d").select("clade", "a", r6("pvalue").alias("pvalue"))


@query("t5_overrepresentation", f"""SELECT category, hits, expected, round(log2ratio, 6) + 0.0 AS log2ratio, behavior, round(pvalue, 6) AS pvalue, round({_bh()}, 6) AS padj FROM (SELECT *, {_RANKED} FROM (SELECT category, hits, round_even(marked * drawn / population, 0) AS expected,
ln(hits / (marked * drawn / population)) / ln(2) AS log2ratio, CASE WHEN hits > marked * drawn / population THEN 'over' WHEN hits < marked * drawn / population THEN 'under' ELSE 'as expected' END AS behavior, {_SF} AS pvalue
FROM (SELECT category, count(*) AS marked, count(*) FILTER (WHERE gene_symbol IN (SELECT gene_symbol FROM genes)) AS hits, (SELECT count(*) FROM (SELECT gene_symbol FROM genes UNION SELECT gene_symbol FROM t2g)) AS population, (SELECT count(*) FROM genes) AS drawn FROM t2g GROUP BY category HAVING count(*) BETWEEN 10 AND 100000)))""", "genes t2g")
def _(v):
    t = T.overrepresentation(v("genes"), v("t2g"), 10, 100000)
    return t.select("category", "hits", "expected", r6("log2ratio").alias("log2ratio"), "behavior", r6("pvalue").alias("pvalue"), r6("padj").alias("padj"))


# The genes that were measured in returned items are the universe.
@query("t5_background", f"""WITH b AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS gene_symbol FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20), l AS (SELECT CAST(l_partkey AS VARCHAR) AS gene_symbol FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > (SELECT sum(l_quantity) / count(DISTINCT l_partkey) FROM lineitem)),
x AS (SELECT p_type AS category, CAST(p_partkey AS VARCHAR) AS gene_symbol FROM part JOIN b ON gene_symbol = CAST(p_partkey AS VARCHAR)) SELECT category, hits, marked, round(pvalue, 6) AS pvalue FROM (SELECT *, {_SF} AS pvalue FROM (SELECT category, count(*) AS marked, count(*) FILTER (WHERE gene_symbol IN (SELECT gene_symbol FROM l)) AS hits, (SELECT count(*) FROM b) AS population, (SELECT count(*) FROM l JOIN b USING (gene_symbol)) AS drawn FROM x GROUP BY category HAVING count(*) BETWEEN 5 AND 100000))""")
def _(v):
    known = v("lineitem").where("l_returnflag = 'R' and l_quantity > 20").select(F.col("l_partkey").cast("string").alias("gene_symbol"))
    return T.overrepresentation(v("genes"), v("t2g"), 5, 100000, background=known).select("category", "hits", "marked", r6("pvalue").alias("pvalue"))


@query("t2_rank_sum_methylation", f""", k AS (SELECT chrom, pos, CAST(meth AS DOUBLE) / (meth + unmeth) AS value, CASE WHEN sample % 2 = 0 THEN 'A' ELSE 'B' END AS g FROM calls) SELECT chrom, pos, round(mean_1, 6) AS mean_1, round(mean_2, 6) AS mean_2, round(ln((mean_2 + 1e-6) / (mean_1 + 1e-6)) / ln(2), 6) + 0.0 AS log2_change, u, round(pvalue, 6) AS pvalue FROM (SELECT chrom, pos, avg(value) FILTER (WHERE g = 'A') AS mean_1, avg(value) FILTER (WHERE g = 'B') AS mean_2 FROM k GROUP BY 1, 2) JOIN (""" + _mw("SELECT chrom, pos, value, g FROM k", "chrom, pos", "A") + ") USING (chrom, pos)", "calls")
def _(v):
    share = v("calls").select("chrom", "pos", "sample", (F.col("meth") / (F.col("meth") + F.col("unmeth"))).alias("value"))
    groups = v("calls").select("sample").distinct().withColumn("condition", F.when(F.col("sample") % 2 == 0, "A").otherwise("B"))
    t = T.rank_sum_methylation(share, groups, "A", "B", ["chrom", "pos"])
    return t.select("chrom", "pos", "u", *[r6(c).alias(c) for c in ("mean_1", "mean_2", "log2_change", "pvalue")])


@query("t19_condition_summary", "SELECT o_orderpriority AS condition, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS deviation, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1")
def _(v):
    t = T.condition_summary(v("orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_totalprice").alias("value")))
    return t.select("condition", "n", *[F.round(c, 4).alias(c) for c in ("mean", "deviation", "q1", "median", "q3")])


@query("t6_bh_fdr", f"SELECT gene_symbol, round({_bh()}, 6) AS padj FROM (SELECT *, {_RANKED} FROM (SELECT gene_symbol, round(pvalue, 9) AS pvalue FROM de))", "de")
def _(v):
    return T.bh_fdr(v("de").select("gene_symbol", F.round("pvalue", 9).alias("pvalue"))).select("gene_symbol", r6("padj").alias("padj"))


@query("t7_differential_utest", f""", kept AS (SELECT f.feature, s.sample, coalesce(c.value, 0) AS value FROM (SELECT feature FROM counts GROUP BY 1 HAVING count(*) FILTER (WHERE value >= 10) > (SELECT count(*) FROM sheet) / 2) f CROSS JOIN sheet s LEFT JOIN counts c ON c.feature = f.feature AND c.sample = s.sample),
one AS ({_PF.format('kept')}), two AS (SELECT feature, sample, ln(1 + value) AS value FROM one), three AS ({_PF.format('two')}), k AS (SELECT feature, value, condition AS g FROM three JOIN sheet USING (sample)), m AS (SELECT feature, median(value) FILTER (WHERE g = 'A') AS mr, median(value) FILTER (WHERE g = 'B') AS mo FROM k GROUP BY 1), t AS ({_mw('SELECT feature, value, g FROM k', 'feature', 'B')})
SELECT feature, round(mr, 6) AS median_ref, round(mo, 6) AS median_other, round(mo - mr, 6) + 0.0 AS log2FoldChange, u, round(pvalue, 6) AS pvalue, round({_bh()}, 6) AS padj FROM (SELECT *, {_RANKED} FROM m JOIN t USING (feature))""", "counts sheet")
def _(v):
    t = T.differential_utest(v("counts"), v("sheet"), "A", "B", 10)
    return t.select("feature", "u", *[r6(c).alias(c) for c in ("median_ref", "median_other", "log2FoldChange", "pvalue", "padj")])


@query("t8_junction_test", f""", g AS (SELECT condition, count(*) AS n FROM sheet GROUP BY 1), m AS (SELECT j.start, j.stop, sum(CASE WHEN condition = 'A' THEN reads ELSE 0 END) / (SELECT n FROM g WHERE condition = 'A') AS m1, sum(CASE WHEN condition = 'B' THEN reads ELSE 0 END) / (SELECT n FROM g WHERE condition = 'B') AS m2, (SELECT n FROM g WHERE condition = 'A') AS n1, (SELECT n FROM g WHERE condition = 'B') AS n2 FROM junctions j JOIN sheet USING (sample) GROUP BY 1, 2),
p AS (SELECT *, {_p('(ln(m2 / m1) / sqrt((1 + m1) / (n1 * m1) + (1 + m2) / (n2 * m2)))')} AS pvalue FROM m WHERE m1 > 0 AND m2 > 0)
SELECT start, stop, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, CASE WHEN m1 = 0 AND m2 = 0 THEN 'absent' WHEN m2 = 0 THEN 'unique_1' ELSE 'unique_2' END AS kind, NULL AS log2FoldChange, NULL AS pvalue, NULL AS padj FROM m WHERE m1 = 0 OR m2 = 0
UNION ALL SELECT start, stop, round(m1, 6), round(m2, 6), 'both', round(ln(m1 / m2) / ln(2), 6) + 0.0, round(pvalue, 6), round({_bh()}, 6) FROM (SELECT *, {_RANKED} FROM p)""", "junctions sheet")
def _(v):
    t = T.junction_test(v("junctions"), v("sheet"), "A", "B")
    return t.select("start", "stop", "kind", *[r6(c).alias(c) for c in ("mean_1", "mean_2", "log2FoldChange", "pvalue", "padj")])


@query("t9_nb_two_group_wald", f"SELECT feature, round(ln(m2 / m1), 6) + 0.0 AS coef, round({_p('(ln(m2 / m1) / sqrt((1 + m1) / (n1 * m1) + (1 + m2) / (n2 * m2)))')}, 6) AS pvalue FROM (SELECT feature, avg(value) FILTER (WHERE sample < 6) AS m1, count(*) FILTER (WHERE sample < 6) AS n1, avg(value) FILTER (WHERE sample >= 6) AS m2, count(*) FILTER (WHERE sample >= 6) AS n2 FROM counts GROUP BY feature) WHERE n1 > 0 AND n2 > 0", "counts")
def _(v):
    at = lambda f, w: f(F.when(F.expr(w), F.col("value")))
    s = v("counts").groupBy("feature").agg(at(F.avg, "sample < 6").alias("m1"), at(F.count, "sample < 6").alias("n1"), at(F.avg, "sample >= 6").alias("m2"), at(F.count, "sample >= 6").alias("n2")).where("n1 > 0 and n2 > 0")
    coef, p = T.nb_two_group_wald(*[F.col(c) for c in ("m1", "n1", "m2", "n2")])
    return s.select("feature", r6(coef).alias("coef"), r6(p).alias("pvalue"))


@query("t10_regression_outliers", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a, 2 * sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)) * sqrt(count(*)) AS most FROM lineitem) WHERE abs(l_extendedprice - a - b * l_quantity) > most")
def _(v):
    return T.regression_outliers(v("lineitem"), "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey")


@query("t11_trend_outliers", """SELECT o_orderkey FROM (SELECT *, 2 * stddev_pop(d) OVER (PARTITION BY bin) AS most FROM (SELECT *, floor((foot - lo) / ((hi - lo) / 19)) AS bin FROM (SELECT o_orderkey, lo, hi, (x + b * (y - a)) / (1 + b * b) AS foot, abs(y - a - b * x) / sqrt(1 + b * b) AS d
FROM (SELECT o_orderkey, o_custkey AS x, o_totalprice / 1000 AS y FROM orders), (SELECT regr_slope(o_totalprice / 1000, o_custkey) AS b, regr_intercept(o_totalprice / 1000, o_custkey) AS a, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders))) WHERE bin BETWEEN 0 AND 19) WHERE d > most""")
def _(v):
    o = v("orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return T.trend_outliers(o, "x", "y").select("o_orderkey")


@query("t12_pearson_by_category", f"""SELECT label, n, round(r, 6) + 0.0 AS r, round({_t_tail('h', 'df')}, 6) AS pvalue FROM (SELECT *, n - 2 AS df, atan(abs(r) / sqrt(1 - r * r)) AS h FROM (SELECT label, count(*) AS n, corr(x, y) AS r FROM (SELECT unnest(['all', l_returnflag]) AS label, l_discount AS x, l_tax AS y FROM lineitem) GROUP BY label))""")
def _(v):
    return T.pearson_by_category(v("lineitem"), "l_discount", "l_tax", "l_returnflag").select("label", "n", r6("r").alias("r"), r6("pvalue").alias("pvalue"))


@query("t13_fit_glm", f"""SELECT response, level, baseline, round(coefficient, 6) + 0.0 AS coefficient, round(error, 6) AS error, round(pvalue, 6) AS pvalue, round({_bh()}, 6) AS padj FROM (SELECT *, {_RANKED} FROM (SELECT *, {_p('(coefficient / error)')} AS pvalue FROM (
SELECT response, CASE WHEN level = b THEN 'Intercept' ELSE level END AS level, b AS baseline, CASE WHEN level = b THEN bm ELSE m - bm END AS coefficient, sqrt(ss / free * (1 / bn + CASE WHEN level = b THEN 0 ELSE 1 / n END)) AS error FROM (
SELECT *, first_value(level) OVER w AS b, first_value(m) OVER w AS bm, first_value(n) OVER w AS bn, sum(n * v) OVER (PARTITION BY response) AS ss, sum(n) OVER (PARTITION BY response) - count(*) OVER (PARTITION BY response) AS free FROM (
SELECT response, level, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m, var_pop(y) AS v FROM (SELECT concat(l_returnflag, l_linenumber) AS level, unnest(['l_quantity', 'l_discount', 'l_tax']) AS response, unnest([l_quantity, l_discount, l_tax]) AS y FROM lineitem) GROUP BY 1, 2) WINDOW w AS (PARTITION BY response ORDER BY level)))))""")
def _(v):
    d = v("lineitem").withColumn("way", F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    t = T.fit_glm(d, ["l_quantity", "l_discount", "l_tax"], "way")
    return t.select("response", "level", "baseline", *[r6(c).alias(c) for c in ("coefficient", "error", "pvalue", "padj")])


@query("t14_genotype_effect", f"""WITH s AS (SELECT l_linenumber AS cell_type, l_returnflag AS genotype, avg(l_tax) AS m, var_samp(l_tax) AS v, count(*) AS n, median(l_tax) AS d FROM lineitem GROUP BY 1, 2), j AS (SELECT s.cell_type, s.genotype, s.m - r.m AS effect, s.d AS median, r.d AS ref_median, s.n + r.n - 2 AS df, ((s.n - 1) * s.v + (r.n - 1) * r.v) / (s.n + r.n - 2) * (1 / s.n + 1 / r.n) AS e2 FROM s JOIN s r ON r.cell_type = s.cell_type AND r.genotype = 'A' WHERE s.genotype <> 'A'),
p AS (SELECT *, {_t_tail('h', 'df')} AS pvalue FROM (SELECT *, atan(abs(effect) / sqrt(e2) / sqrt(df)) AS h FROM j)) SELECT cell_type, genotype, round(effect, 6) + 0.0 AS effect, round(pvalue, 6) AS pvalue, CASE WHEN pvalue < 0.05 THEN CASE WHEN effect > 0 THEN 'enriched' ELSE 'depleted' END ELSE 'ns' END AS flag, median, ref_median FROM p""")
def _(v):
    d = v("lineitem").select(F.col("l_linenumber").alias("cell_type"), F.col("l_returnflag").alias("genotype"), F.col("l_tax").alias("value"))
    return T.genotype_effect(d, "A").withColumns({"effect": r6("effect"), "pvalue": r6("pvalue")})


@query("t15_gene_linear_model", f""", k AS (SELECT f.feature, condition, coalesce(c.value, 0) AS v FROM (SELECT DISTINCT feature FROM counts) f CROSS JOIN sheet s LEFT JOIN counts c ON c.feature = f.feature AND c.sample = s.sample),
m AS (SELECT feature, avg(v) FILTER (WHERE condition = 'A') AS a, avg(v) FILTER (WHERE condition = 'B') AS b, count(*) FILTER (WHERE condition = 'A') AS na, count(*) FILTER (WHERE condition = 'B') AS nb, var_samp(v) FILTER (WHERE condition = 'A') AS va, var_samp(v) FILTER (WHERE condition = 'B') AS vb FROM k GROUP BY 1),
n AS (SELECT feature, b - a AS change, na + nb - 2 AS df, atan(abs(b - a) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) / sqrt(na + nb - 2)) AS h FROM m), p AS (SELECT feature, change, {_t_tail('h', 'df')} AS pvalue FROM n)
SELECT feature, round(change, 6) + 0.0 AS change, round(pvalue, 6) AS pvalue, round({_bh()}, 6) AS padj FROM (SELECT *, {_RANKED} FROM p)""", "counts sheet")
def _(v):
    return T.gene_linear_model(v("counts"), v("sheet"), "A", "B").select("feature", *[r6(c).alias(c) for c in ("change", "pvalue", "padj")])


@query("t16_nb_differential", f""", {_FACTORS}, r AS (SELECT f.feature, condition, coalesce(value, 0) / size_factor AS v FROM (SELECT DISTINCT feature FROM counts) f, sheet s JOIN sf USING (sample) LEFT JOIN counts c ON c.feature = f.feature AND c.sample = s.sample),
a AS (SELECT feature, avg(v) FILTER (WHERE condition = 'A') AS m0, var_samp(v) FILTER (WHERE condition = 'A') AS v0, CAST(count(*) FILTER (WHERE condition = 'A') AS DOUBLE) AS n0, avg(v) FILTER (WHERE condition = 'B') AS m1, var_samp(v) FILTER (WHERE condition = 'B') AS v1, CAST(count(*) FILTER (WHERE condition = 'B') AS DOUBLE) AS n1 FROM r GROUP BY 1),
b AS (SELECT *, (m0 * n0 + m1 * n1) / (n0 + n1) AS mean, ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) AS var, greatest(m0, 0.5) AS g0, greatest(m1, 0.5) AS g1 FROM a), c AS (SELECT *, greatest((var - mean) / mean ** 2, 1e-8) AS alpha FROM b WHERE mean > 0),
d AS (SELECT *, ln(g1 / g0) / sqrt((1 / g0 + alpha) / n0 + (1 / g1 + alpha) / n1) AS z FROM c), p AS (SELECT *, {_p('z')} AS pvalue FROM d)
SELECT feature, round(mean, 6) AS base_mean, round(ln(g1 / g0) / ln(2), 6) + 0.0 AS log2FoldChange, round(alpha, 6) AS dispersion, round(z, 6) + 0.0 AS z, round(pvalue, 6) AS pvalue, round({_bh()}, 6) AS padj FROM (SELECT *, {_RANKED} FROM p)""", "counts sheet")
def _(v):
    t = T.nb_differential(v("counts"), v("sheet"), "A", "B")
    return t.select("feature", *[r6(c).alias(c) for c in ("base_mean", "log2FoldChange", "dispersion", "z", "pvalue", "padj")])


@query("t16_nb_likelihood_ratio")
def _(v):
    return T.nb_likelihood_ratio(v("counts"), v("sheet"), ["A", "B"])


_LL = "(CASE WHEN {m} > 0 THEN {m} * ln({m} / ({m} + {u})) ELSE 0 END + CASE WHEN {u} > 0 THEN {u} * ln({u} / ({m} + {u})) ELSE 0 END)"
_DEVIANCE = f"greatest(2 * ({_LL.format(m='m1', u='u1')} + {_LL.format(m='m2', u='u2')} - {_LL.format(m='(m1 + m2)', u='(u1 + u2)')}), 0)"
_GROUP_X2 = "CASE WHEN m{0} * u{0} > 0 THEN (s{0} - m{0} * m{0} / (m{0} + u{0})) / (m{0} * u{0} / pow(m{0} + u{0}, 2)) ELSE 0 END"


@query("t17_diff_methylation", f"""SELECT chrom, pos, round(difference, 6) + 0.0 AS difference, round(pvalue, 6) AS pvalue, round({_bh()}, 6) AS qvalue FROM (SELECT *, {_RANKED} FROM (SELECT chrom, pos, difference, round({_p('sqrt(deviance / phi)')}, 12) AS pvalue FROM (
SELECT chrom, pos, 100 * (m2 / (m2 + u2) - m1 / (m1 + u1)) AS difference, {_DEVIANCE} AS deviance, CASE WHEN k > 2 THEN greatest(({_GROUP_X2.format(1)} + {_GROUP_X2.format(2)}) / (k - 2), 1) ELSE 1 END AS phi FROM (
SELECT chrom, pos, count(*) AS k, sum(meth) FILTER (WHERE sample IN (0, 2)) AS m1, sum(unmeth) FILTER (WHERE sample IN (0, 2)) AS u1, sum(meth) FILTER (WHERE sample IN (1, 3)) AS m2, sum(unmeth) FILTER (WHERE sample IN (1, 3)) AS u2, sum(meth * meth / (meth + unmeth)) FILTER (WHERE sample IN (0, 2)) AS s1, sum(meth * meth / (meth + unmeth)) FILTER (WHERE sample IN (1, 3)) AS s2
FROM (SELECT chrom % 3 AS chrom, pos, sample, CAST(sum(meth) AS DOUBLE) AS meth, CAST(sum(unmeth) AS DOUBLE) AS unmeth FROM calls GROUP BY 1, 2, 3) WHERE meth + unmeth > 0 GROUP BY 1, 2) WHERE m1 + u1 > 0 AND m2 + u2 > 0)))""", "calls")
def _(v):
    groups = v("calls").select("sample").distinct().withColumn("condition", F.when(F.col("sample") % 2 == 0, "A").otherwise("B"))
    t = T.diff_methylation(v("calls").withColumn("chrom", F.col("chrom") % 3), groups, "A", "B")
    return t.select("chrom", "pos", r6("difference").alias("difference"), r6("pvalue").alias("pvalue"), r6("qvalue").alias("qvalue"))


@query("t18_gene_signature_score")
def _(v):
    return T.gene_signature_score(v("counts"), v("genes").select(F.col("gene_symbol").cast("long").alias("feature")))


@query("t19_pairwise_condition_tests", f"SELECT one, two, n1, n2, round(z, 6) AS z, round(pvalue, 6) AS pvalue, round({_bh()}, 6) AS padj FROM (SELECT *, {_RANKED} FROM (" + _mw("SELECT a.l_returnflag AS one, b.l_returnflag AS two, l.l_quantity AS value, CASE WHEN l.l_returnflag = a.l_returnflag THEN 'one' ELSE 'two' END AS g FROM lineitem l, (SELECT DISTINCT l_returnflag FROM lineitem) a, (SELECT DISTINCT l_returnflag FROM lineitem) b WHERE a.l_returnflag < b.l_returnflag AND l.l_returnflag IN (a.l_returnflag, b.l_returnflag)", "one, two", "one") + "))")
def _(v):
    t = T.pairwise_condition_tests(v("lineitem").select(F.col("l_returnflag").alias("condition"), F.col("l_quantity").alias("value")))
    return t.select("one", "two", "n1", "n2", *[r6(c).alias(c) for c in ("z", "pvalue", "padj")])


@query("t20_nested_resampling_test")
def _(v):
    d = v("lineitem").select((F.col("l_suppkey") % 2).cast("string").alias("treatment"), F.col("l_suppkey").alias("replicate"), F.col("l_quantity").alias("value"))
    return T.nested_resampling_test(d, "0", "1", 300, 5)


@query("t21_preranked_gsea")
def _(v):
    ranks = v("de").select("gene_symbol", (F.signum("log2FoldChange") * -F.log10(F.greatest(F.coalesce("padj", F.lit(1.0)), F.lit(1e-300)))).alias("score"))
    return T.preranked_gsea(ranks, v("t2g"), 10, 100000, 100, most_rounds=1000)


@query("t22_polygenic_score", "SELECT sample, round(coalesce(sum(w * 2), 0), 6) AS score, count(w) AS alleles FROM (SELECT DISTINCT sample FROM variants) s LEFT JOIN (SELECT v.sample, p.w FROM (SELECT sample, chrom, pos + i AS pos, substr(alt, CAST(i + 1 AS INT), 1) AS base FROM variants, (SELECT unnest(range(2)) AS i) WHERE length(ref) = length(alt) AND dp >= 20 AND i < length(alt)) v JOIN (SELECT concat('chr', o_custkey % 22 + 1) AS chrom, o_orderkey AS pos, 'A' AS base, o_totalprice / 1e6 AS w FROM orders) p USING (chrom, pos, base)) USING (sample) GROUP BY sample", "variants")
def _(v):
    calls = v("variants").select("sample", "chrom", "pos", "ref", "alt", F.lit(2).alias("copies"), F.col("dp").alias("depth"))
    w = v("orders").select(F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")).alias("chrom"), F.col("o_orderkey").alias("pos"), F.lit("A").alias("effect_allele"), (F.col("o_totalprice") / 1e6).alias("effect_weight"))
    return T.polygenic_score(calls, w).withColumn("score", r6("score"))


@query("t23_model_eval_cv")
def _(v):
    from pyspark.ml.classification import LogisticRegression

    rows = v("labels").join(v("documents"), "doc_id").withColumn("words", F.size(F.split("text", " ")))
    return T.model_eval_cv(rows, ["n_chars", "words"], "quality", "doc_id", LogisticRegression(maxIter=10), 3)


@query("t23_model_eval_splits")
def _(v):
    rows = v("labels").join(v("documents"), "doc_id").withColumn("words", F.size(F.split("text", " ")))
    some = {k: m for k, m in T.classifiers().items() if k in ("logistic", "tree")}
    return T.model_eval_splits(rows, ["n_chars", "words"], "quality", "doc_id", some, 3)


@query("t23_stratified_splits", """WITH r AS (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT round, CAST(quality AS DOUBLE) AS label, CAST(round_even(0.2 * n, 0) AS BIGINT) AS tested, n AS rows FROM (SELECT DISTINCT quality, n FROM r), (SELECT unnest(range(1, 11)) AS round)""")
def _(v):
    marked = T.stratified_splits(v("labels"), "quality", "doc_id", 10)
    each = marked.select(F.col("quality").cast("double").alias("label"), F.posexplode("tested").alias("round", "t"))
    return each.groupBy((F.col("round") + 1).cast("long").alias("round"), "label").agg(F.count_if("t").alias("tested"), F.count(F.lit(1)).alias("rows"))


@query("t24_label_encode", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def _(v):
    return T.label_encode(v("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "code")


@query("q18_linear_fit", f"""SELECT l_linenumber, round(slope, 6) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, round(r, 6) + 0.0 AS r, n, round({_t_tail('h', 'df')}, 6) AS pvalue FROM (SELECT *, n - 2 AS df, atan(abs(r) / sqrt(1 - r * r)) AS h FROM (SELECT l_linenumber, regr_slope(l_tax, l_discount) AS slope, regr_intercept(l_tax, l_discount) AS intercept, corr(l_discount, l_tax) AS r, count(*) AS n FROM lineitem GROUP BY 1))""")
def _(v):
    t = T.linear_fit(v("lineitem"), "l_discount", "l_tax", ["l_linenumber"])
    return t.select("l_linenumber", r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r").alias("r"), "n", r6("pvalue").alias("pvalue"))


@query("n2_size_factors", f", {_FACTORS} SELECT sample, round(size_factor, 6) AS size_factor FROM sf", "counts")
def _(v):
    return N.size_factors(v("counts")).select("sample", r6("size_factor").alias("size_factor"))
