"""Queries of exploration, hierarchies, communities, text, sequences and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import sql_erfc
from ..functions.storage import shared_folder
from ..operators import community as C
from ..operators import exploration as Q
from ..operators import hierarchy as H
from ..operators import sequences as G
from ..operators import text as E
from ..sources import readers as S
from .registry import query, r6

_MIXED = "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS a, CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE c_mktsegment END AS b FROM customer"


def _mixed(v):
    k = F.col("c_custkey")
    return v("customer").select("c_custkey", F.when(k % 10 == 0, None).when(k % 7 == 0, "x").otherwise(k.cast("string")).alias("a"), F.when(k % 3 == 0, "true").otherwise(F.col("c_mktsegment")).alias("b"))


@query("q1_infer_value_types", f"SELECT 'a' AS column, 'int' AS type, count(*) FILTER (WHERE a = 'x') AS wrong, count(a) AS total FROM ({_MIXED}) UNION ALL SELECT 'b', 'MIXED', count(*) FILTER (WHERE b = 'true'), count(*) FROM ({_MIXED})")
def _(v):
    return Q.infer_value_types(_mixed(v), ["a", "b"])


# A file for each region, whose columns are named after its nations; some names are blank or made up by an export.
@query("q2_missing_header", """SELECT CAST(n_regionkey AS INT) AS region, CAST(position AS INT) AS position, name FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position, CASE WHEN n_nationkey % 5 = 3 THEN '' WHEN n_nationkey % 7 = 2 THEN 'Unnamed: ' || n_nationkey ELSE n_name END AS name FROM nation) WHERE name = '' OR name LIKE 'Unnamed%'""")
def _(v):
    k = F.col("n_nationkey")
    name = F.when(k % 5 == 3, "").when(k % 7 == 2, F.concat(F.lit("Unnamed: "), k.cast("string"))).otherwise(F.col("n_name"))
    rows = v("nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct(k, name.alias("name")))).alias("x"))
    head = F.array_join(F.transform("x", lambda x: x["name"]), "\t")
    body = F.array_join(F.transform("x", lambda x: x["n_nationkey"].cast("string")), "\t")
    rows.select("region", F.concat(head, F.lit("\n"), body).alias("value")).write.partitionBy("region").text(path := _folder(v))
    found = Q.missing_headers(S.file_headers(v.spark, path + "/*"))
    return found.select(F.regexp_extract("file", r"region=(\d+)", 1).cast("int").alias("region"), "position", "name")


@query("q3_missing_values", f"SELECT 'a' AS column, round(avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0 END), 6) AS missing FROM ({_MIXED})")
def _(v):
    return Q.missing_values(_mixed(v), ["a", "b"], 0.05).withColumn("missing", r6("missing"))


@query("q4_rare_categories", """WITH c AS (SELECT CASE WHEN o_orderkey % 997 = 0 THEN o_orderpriority || 'x' ELSE o_orderpriority END AS category, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT count(*) AS k, sum(n) AS whole, sum(n) FILTER (WHERE n > 3) AS often, max(n) AS hi, min(n) AS lo FROM c),
g AS (SELECT n AS cut FROM (SELECT n, rank() OVER (ORDER BY n DESC) - 1 AS i FROM c), f WHERE often >= 0.75 * whole AND k <= 0.1 * whole ORDER BY round(hi + (lo - hi) * i / k - n, 9) DESC, i LIMIT 1),
p AS (SELECT r.category, r.n, m.category AS common, coalesce(list_sum([CASE WHEN substr(r.category, CAST(i AS INT), 1) = substr(m.category, CAST(i AS INT), 1) THEN 1 ELSE 0 END FOR i IN range(1, least(length(r.category), length(m.category)) + 1)]), 0) / greatest(least(length(r.category), length(m.category)), 1) AS likeness FROM c r, c m, g WHERE r.n < cut AND m.n >= cut)
SELECT category, n, CASE WHEN likeness >= 0.5 THEN common END AS typo_of FROM p QUALIFY row_number() OVER (PARTITION BY category ORDER BY likeness DESC, common DESC) = 1""")
def _(v):
    odd = F.when(F.col("o_orderkey") % 997 == 0, F.concat("o_orderpriority", F.lit("x"))).otherwise(F.col("o_orderpriority"))
    return Q.rare_categories(v("orders").select(odd.alias("p")), "p")


def _with_gaps(v):
    return v("customer").select("c_acctbal", F.when(F.col("c_nationkey") % 7 != 3, F.col("c_nationkey")).alias("nation"), F.when(F.col("c_acctbal") > 2000, F.col("c_mktsegment")).alias("seg"))


_GAPS = "d AS (SELECT c_acctbal AS a, CASE WHEN c_nationkey % 7 <> 3 THEN CAST(c_nationkey AS DOUBLE) END AS n, CASE WHEN c_acctbal > 2000 THEN c_mktsegment END AS s FROM customer)"
_RANK_P = """SELECT {0} AS c, {1} AS t, {2} AS pvalue FROM (SELECT greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM (SELECT CAST(sum(k) AS DOUBLE) AS n1, CAST(sum(m) AS DOUBLE) AS n2, sum(k * (b + (k + m + 1) / 2)) - sum(k) * (sum(k) + 1) / 2 AS u, CAST(sum((k + m) ** 3 - (k + m)) AS DOUBLE) AS ties
FROM (SELECT *, coalesce(sum(k + m) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT {3} AS x, count(*) AS k, count({4}) AS m FROM d WHERE {3} IS NOT NULL GROUP BY 1))))"""
_SQUARE_P = "SELECT {0} AS c, {1} AS t, {2} AS pvalue FROM (SELECT (pow(x / df, 1 / 3) - 1 + 2 / (9 * df)) / sqrt(2 / (9 * df)) AS z FROM (SELECT sum((m - k * r) ** 2 / (k * r)) AS x, count(*) - 1.0 AS df FROM (SELECT *, sum(m) OVER () / sum(k) OVER () AS r FROM (SELECT {3} AS x, count(*) AS k, count({4}) AS m FROM d WHERE {3} IS NOT NULL GROUP BY 1))))"


def _tail(z):
    return f"least(1.0, {sql_erfc(f'abs({z})/sqrt(2)')})"


@query("q5_missingness_tests", f"WITH {_GAPS} SELECT c AS column, t AS tested, round(pvalue, 6) AS pvalue FROM (" + " UNION ALL ".join([
    _RANK_P.format("'nation'", "'c_acctbal'", _tail("z"), "a", "n"), _RANK_P.format("'seg'", "'c_acctbal'", _tail("z"), "a", "s"), _RANK_P.format("'seg'", "'nation'", _tail("z"), "n", "s"), _SQUARE_P.format("'nation'", "'seg'", _tail("z"), "s", "n")]) + ")")
def _(v):
    d = _with_gaps(v)
    return Q.missingness_tests(d, d.columns, ["nation", "seg"]).withColumn("pvalue", r6("pvalue"))


@query("q5_missingness_report", f"WITH d AS (SELECT c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS n, CASE WHEN c_acctbal > 2000 THEN c_mktsegment END AS s FROM customer) SELECT 'seg' AS column, round((SELECT avg(CASE WHEN s IS NULL THEN 1.0 ELSE 0 END) FROM d), 6) AS missing, CASE WHEN avg(CASE WHEN pvalue >= 0.05 THEN 1.0 ELSE 0 END) < 0.05 THEN 'MNAR' ELSE 'not MNAR' END AS verdict FROM ({_RANK_P.format("'seg'", "'a'", _tail('z'), 'a', 's')} UNION ALL {_RANK_P.format("'seg'", "'n'", _tail('z'), 'n', 's')})")
def _(v):
    d = v("customer").select("c_acctbal", "c_nationkey", F.when(F.col("c_acctbal") > 2000, F.col("c_mktsegment")).alias("seg"))
    return Q.missingness_report(d, ["c_acctbal", "c_nationkey", "seg"]).withColumn("missing", r6("missing"))


@query("q1_wrong_values", "SELECT 'priority' AS column, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 53 = 0 THEN 'none' ELSE 'true' END AS value, CASE WHEN o_orderkey % 53 = 0 THEN 'str' ELSE 'bool' END AS type, 'int' AS wanted FROM orders WHERE o_orderkey % 53 = 0 OR o_orderkey % 59 = 0 UNION ALL SELECT 'price', CAST(o_orderkey AS VARCHAR), 'n/a', 'str', 'float' FROM orders WHERE o_orderkey % 61 = 0")
def _(v):
    k = F.col("o_orderkey")
    d = v("orders").select(k.cast("string").alias("o"), F.when(k % 53 == 0, "none").when(k % 59 == 0, "true").otherwise((k % 5).cast("string")).alias("priority"), F.when(k % 61 == 0, "n/a").otherwise((F.floor("o_totalprice") + 0.5).cast("string")).alias("price"))
    return Q.wrong_values(d, "o", ["priority", "price"])


@query("q6_iqr_outliers", "SELECT event_id FROM events, (SELECT median(value) FILTER (WHERE value < m) AS a, median(value) FILTER (WHERE value > m) AS b FROM events, (SELECT median(value) AS m FROM events)) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def _(v):
    return Q.iqr_outliers(v("events"), "event_id", "value")


@query("q7_z_outliers", "SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs(value - m) > 2 * s")
def _(v):
    return Q.z_outliers(v("events"), "event_id", "value", 2.0)


@query("q8_mad_outliers", "SELECT event_id FROM events, (SELECT m, median(abs(value - m)) AS mad FROM events, (SELECT median(value) AS m FROM events) GROUP BY m) WHERE 0.6745 * abs(value - m) / mad > 2")
def _(v):
    return Q.mad_outliers(v("events"), "event_id", "value", 2.0)


@query("q9_mahalanobis", "SELECT l_orderkey, l_linenumber, l_partkey, round((d1 * d1 * c22 - 2 * d1 * d2 * c12 + d2 * d2 * c11) / (c11 * c22 - c12 * c12), 4) AS d2 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - avg(l_quantity) OVER () AS d1, l_discount - avg(l_discount) OVER () AS d2 FROM lineitem), (SELECT var_samp(l_quantity) AS c11, var_samp(l_discount) AS c22, covar_samp(l_quantity, l_discount) AS c12 FROM lineitem)")
def _(v):
    d = v("lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return Q.mahalanobis_distance(d, "k", ["l_quantity", "l_discount"]).select("k.*", F.round("d2", 4).alias("d2"))


@query("q10_remove_outliers", """WITH m AS (SELECT median(value) AS m, avg(value) AS mean, stddev_pop(value) AS s FROM events), h AS (SELECT median(value) FILTER (WHERE value < m) AS a, median(value) FILTER (WHERE value > m) AS b, median(abs(value - m)) AS mad FROM events, m)
SELECT event_id FROM events, m, h WHERE NOT coalesce(CAST(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS INT) + CAST(abs(value - mean) > 3 * s AS INT) + CAST(mad > 0 AND 0.6745 * abs(value - m) / mad > 3 AS INT) > 1, false)""")
def _(v):
    return Q.remove_outliers(v("events"), "event_id", ["value"], mahalanobis=False).select("event_id")


@query("q11_continuous_columns", "SELECT 'o_totalprice' AS column, count(*) AS n FROM orders")
def _(v):
    o = v("orders").withColumn("code", (F.col("o_orderkey") % 3).cast("int"))
    found = Q.continuous_columns(o, ["o_totalprice", "code", "o_orderstatus"])
    return o.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, found))).alias("column"), "n")


_PAIR = "WITH RECURSIVE d AS (SELECT l_quantity AS x, l_quantity * 2 + l_discount AS y FROM lineitem), p AS (SELECT x, y, count(*) AS n FROM d GROUP BY ALL), rk AS (SELECT corr(rx, ry) AS r FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM d))"
_TIED = "(SELECT sum(n * (n - 1)) / 2 FROM (SELECT sum(n) AS n FROM p GROUP BY {}))"


# Of the three pairs of columns only this one passes; the other two have a squared correlation under the limit.
@query("q12_correlated_columns", f"""{_PAIR} SELECT 'l_quantity' AS a, 'double_quantity' AS b, round((SELECT corr(x, y) FROM d), 6) AS pearson, round((SELECT r FROM rk), 6) AS spearman, round((SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.n * b.n ELSE -a.n * b.n END) FROM p a, p b WHERE a.x < b.x AND a.y <> b.y)
/ sqrt(((SELECT count(*) * (count(*) - 1) / 2 FROM d) - {_TIED.format('x')}) * ((SELECT count(*) * (count(*) - 1) / 2 FROM d) - {_TIED.format('y')})), 6) AS kendall, 'double_quantity' AS "group" WHERE (SELECT max(r * r) FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT corr(l_quantity * 2 + l_discount, l_extendedprice) FROM lineitem)) < 0.75""")
def _(v):
    d = v("lineitem").select("l_quantity", "l_extendedprice", (F.col("l_quantity") * 2 + F.col("l_discount")).alias("double_quantity"))
    return Q.correlated_columns(d, d.columns).withColumns({c: r6(c) for c in ("pearson", "spearman", "kendall")})


_POWERS = {"none": ("value", "true"), "log1p": ("ln(1 + value)", "value > -1"), "sqrt": ("sqrt(value)", "value >= 0"), "cbrt": ("sign(value) * pow(abs(value), 1 / 3.0)", "true"), "boxcox_0": ("ln(value)", "value > 0")} | {
    f"boxcox_{p:g}": (f"(pow(value, {p}) - 1) / {p}", "value > 0") for p in (-1.0, -0.5, 0.25, 0.5, 2.0)
}


@query("q13_distribution_check", " UNION ALL ".join(f"SELECT '{n}' AS transform, count(*) AS n, round(skewness({e}), 5) AS skew, round(kurtosis({e}), 4) AS kurtosis FROM events WHERE {w} HAVING count(*) > 20" for n, (e, w) in _POWERS.items()))
def _(v):
    return Q.distribution_check(v("events"), "value").select("transform", "n", F.round("skew", 5).alias("skew"), F.round("kurtosis", 4).alias("kurtosis"))


@query("q14_apply_best_transform")
def _(v):
    return Q.apply_best_transform(v("events").select("event_id", "value"), "value")


# Two columns have one component up to the elbow: the axis of the greater variance, in closed form.
@query("q15_knn_impute", """WITH d AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey) AS k, min(l_quantity) AS a, min(l_discount) AS b, CASE WHEN l_orderkey % 50 <> 0 THEN min(l_extendedprice) END AS price, CASE WHEN l_partkey % 50 <> 0 THEN min(l_tax) END AS tax FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey),
z AS (SELECT *, (a - (SELECT avg(a) FROM d)) / ((SELECT stddev_pop(a) FROM d) + 1e-6) AS za, (b - (SELECT avg(b) FROM d)) / ((SELECT stddev_pop(b) FROM d) + 1e-6) AS zb FROM d),
t AS (SELECT 0.5 * atan2(2 * covar_samp(za, zb), var_samp(za) - var_samp(zb)) AS t FROM z), p AS (SELECT k, price, tax, round(za * cos(t) + zb * sin(t), 9) AS x FROM z, t),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY k) AS r FROM p) WHERE r <= 10),
f AS (SELECT q.k, m.price, m.tax, row_number() OVER (PARTITION BY q.k ORDER BY round((q.x - m.x) ** 2, 9), m.k) AS r FROM p q, m WHERE (q.price IS NULL OR q.tax IS NULL) AND q.k <> m.k),
g AS (SELECT k, list(price ORDER BY r) FILTER (WHERE price IS NOT NULL) AS prices, list(tax ORDER BY r) FILTER (WHERE tax IS NOT NULL) AS taxes FROM f WHERE r <= 9 GROUP BY k)
SELECT p.k, coalesce(price, list_median(prices[1:3]), (SELECT median(price) FROM p)) AS price, coalesce(tax, list_median(taxes[1:3]), (SELECT median(tax) FROM p)) AS tax FROM p LEFT JOIN g ON p.k = g.k""")
def _(v):
    d = v("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_quantity").alias("a"), F.min("l_discount").alias("b"), F.min("l_extendedprice").alias("price"), F.min("l_tax").alias("tax"))
    d = d.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("k"), "a", "b", F.when(F.col("l_orderkey") % 50 != 0, F.col("price")).alias("price"), F.when(F.col("l_partkey") % 50 != 0, F.col("tax")).alias("tax"))
    return Q.knn_impute(d, "k", ["a", "b"], ["price", "tax"]).select("k", "price", "tax")


@query("q16_registries", f"SELECT 'missing' AS rule, 'a' AS column, round(avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0 END), 6) AS missing, NULL AS type FROM ({_MIXED}) UNION ALL SELECT 'types', 'a', NULL, 'int' UNION ALL SELECT 'types', 'b', NULL, 'MIXED'")
def _(v):
    rules = Q.RuleRegistry().add("missing", lambda d: Q.missing_values(d, ["a", "b"], 0.05)).add("types", lambda d: Q.infer_value_types(d, ["a", "b"]).select("column", "type"))
    return rules.inspect(_mixed(v)).select("rule", "column", r6("missing").alias("missing"), "type")


@query("q17_sample_correlation", "WITH r AS (SELECT feature, sample, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS v FROM counts) SELECT a.sample AS a, b.sample AS b, round(corr(a.v, b.v), 6) + 0.0 AS r FROM r a JOIN r b USING (feature) WHERE a.sample < b.sample GROUP BY 1, 2".replace("WITH r AS", ", r AS"), "counts")
def _(v):
    return Q.sample_correlation(v("counts")).withColumn("r", r6("r"))


@query("q19_sample_distance", ", s AS (SELECT DISTINCT sample FROM counts), f AS (SELECT feature, s.sample, coalesce(value, 0) AS value FROM (SELECT DISTINCT feature FROM counts) x CROSS JOIN s LEFT JOIN counts USING (feature, sample)) SELECT a.sample AS a, b.sample AS b, round(sqrt(sum((a.value - b.value) ** 2)), 6) AS distance FROM f a JOIN f b USING (feature) WHERE a.sample < b.sample GROUP BY 1, 2", "counts")
def _(v):
    return Q.sample_distance(v("counts")).withColumn("distance", r6("distance"))


@query("q20_mean_variance", "SELECT feature, round(log10(nullif(avg(value), 0)), 6) AS log_mean, round(log10(nullif(var_samp(value), 0)), 6) AS log_variance FROM counts GROUP BY feature", "counts")
def _(v):
    return Q.mean_variance(v("counts")).select("feature", r6("log_mean").alias("log_mean"), r6("log_variance").alias("log_variance"))


_DOWN = ", c AS (SELECT parent AS seed, parent AS node, 0 AS depth FROM (SELECT DISTINCT parent FROM edges) UNION SELECT c.seed, e.child, c.depth + 1 FROM c JOIN edges e ON e.parent = c.node)"


def _nodes(v, like):
    return v("edges").select(F.explode(F.array("parent", "child")).alias("node")).distinct().where(F.col("node").like(like))


@query("h1_descendants", _DOWN + " SELECT DISTINCT seed, node, depth FROM c", "edges")
def _(v):
    return H.closure(v("edges"), v("edges").select(F.col("parent").alias("node")))


@query("h1_ancestors", ", c AS (SELECT child AS seed, child AS node, 0 AS depth FROM edges UNION SELECT c.seed, e.parent, c.depth + 1 FROM c JOIN edges e ON e.child = c.node) SELECT DISTINCT seed, node, depth FROM c", "edges")
def _(v):
    return H.closure(v("edges"), v("edges").select(F.col("child").alias("node")), down=False)


@query("h2_distance", _DOWN + " SELECT r.node AS parent, k.node AS child, c.depth AS distance FROM (SELECT DISTINCT parent AS node FROM edges WHERE parent LIKE 'R%') r CROSS JOIN (SELECT DISTINCT child AS node FROM edges WHERE child LIKE 'S%') k LEFT JOIN c ON c.seed = r.node AND c.node = k.node", "edges")
def _(v):
    pairs = _nodes(v, "R%").withColumnRenamed("node", "parent").crossJoin(_nodes(v, "S%").withColumnRenamed("node", "child"))
    return H.distance(v("edges"), pairs).select("parent", "child", "distance")


_UP = ", c AS (SELECT child AS seed, child AS node, 0 AS depth FROM edges WHERE child LIKE 'S%' UNION SELECT c.seed, e.parent, c.depth + 1 FROM c JOIN edges e ON e.child = c.node)"


@query("h3_closest_common_ancestor", _UP + " SELECT a, b, coalesce(m.node, '') AS ancestor, coalesce(m.d, -1) AS distance FROM (SELECT x.s AS a, y.s AS b FROM (SELECT DISTINCT seed AS s FROM c) x, (SELECT DISTINCT seed AS s FROM c) y WHERE x.s < y.s) LEFT JOIN (SELECT x.seed AS a, y.seed AS b, arg_min(x.node, (x.depth + y.depth, x.node)) AS node, min(x.depth + y.depth) + 1 AS d FROM c x JOIN c y USING (node) GROUP BY 1, 2) m USING (a, b)", "edges")
def _(v):
    return H.closest_common_ancestors(v("edges"), _nodes(v, "S%"))


@query("h4_pairwise_distance", ", c AS (SELECT node AS seed, node, 0 AS depth FROM (SELECT DISTINCT child AS node FROM edges WHERE child LIKE 'N%' UNION SELECT parent FROM edges WHERE parent LIKE 'R%') UNION SELECT c.seed, e.parent, c.depth + 1 FROM c JOIN edges e ON e.child = c.node), t AS (SELECT DISTINCT seed AS s FROM c) SELECT x.s AS a, y.s AS b, coalesce((SELECT min(depth) FROM c WHERE (seed = x.s AND node = y.s) OR (seed = y.s AND node = x.s)), (SELECT min(p.depth + q.depth) + 1 FROM c p JOIN c q USING (node) WHERE p.seed = x.s AND q.seed = y.s), -1) AS distance FROM t x, t y WHERE x.s < y.s", "edges")
def _(v):
    return H.pairwise_distance(v("edges"), _nodes(v, "N%").union(_nodes(v, "R%")))


@query("h5_leaf_terms", "SELECT DISTINCT child AS node FROM edges WHERE child LIKE 'N%' UNION SELECT parent FROM edges WHERE parent LIKE 'R%' AND parent NOT IN (SELECT parent FROM edges WHERE child LIKE 'N%')", "edges")
def _(v):
    return H.leaf_terms(v("edges"), _nodes(v, "N%").union(_nodes(v, "R%")))


@query("h5_shared_ancestors", "SELECT parent AS node, count(DISTINCT child) AS leaves FROM edges WHERE child LIKE 'N%' GROUP BY parent HAVING count(DISTINCT child) > 1", "edges")
def _(v):
    return H.shared_ancestors(v("edges"), _nodes(v, "N%"))


# A nation is the one cluster of its suppliers: alone, as the next term up, or as the lowest term that they share.
@query("h6_simplify_terms", "SELECT node, CAST(dense_rank() OVER (ORDER BY representative) - 1 AS INT) AS cluster, representative FROM (SELECT DISTINCT child AS node, CASE WHEN child LIKE 'S%' THEN parent ELSE child END AS representative FROM edges WHERE child LIKE 'S%' OR child LIKE 'N%')", "edges")
def _(v):
    return H.simplify_terms(v("edges"), _nodes(v, "N%").union(_nodes(v, "S%")), 2)


@query("h7_term2gene", ", c AS (SELECT node AS seed, node FROM (SELECT parent AS node FROM edges UNION SELECT child FROM edges) UNION SELECT c.seed, e.child FROM c JOIN edges e ON e.parent = c.node) SELECT DISTINCT c.seed AS term, o_orderkey AS gene FROM c JOIN orders ON c.node = concat('C', o_custkey)", "edges")
def _(v):
    return H.term2gene(v("edges"), v("orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("term"), F.col("o_orderkey").alias("gene")))


@query("h8_name_hierarchy", "SELECT coalesce(a.n_name, parent) AS parent, coalesce(b.n_name, child) AS child FROM edges LEFT JOIN nation a ON parent = concat('N', a.n_nationkey) LEFT JOIN nation b ON child = concat('N', b.n_nationkey)", "edges")
def _(v):
    return H.name_hierarchy(v("edges"), v("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")))


@query("h9_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(v):
    return H.lookup(v("customer").withColumnRenamed("c_nationkey", "taxid"), v("nation").select(F.col("n_nationkey").alias("taxid"), "n_name"), "taxid").select("c_custkey", "n_name")


@query("c1_shannon_index", "SELECT sample, round(-sum(p * ln(p)), 6) AS shannon FROM (SELECT sample, value / sum(value) OVER (PARTITION BY sample) AS p FROM counts WHERE value > 0) GROUP BY sample", "counts")
def _(v):
    return C.shannon_index(v("counts")).withColumn("shannon", r6("shannon"))


@query("c2_log10_richness", "SELECT sample, round(log10(count(*) FILTER (WHERE value > 0)), 6) AS richness FROM counts GROUP BY sample", "counts")
def _(v):
    return C.log10_richness(v("counts")).withColumn("richness", r6("richness"))


@query("c3_bray_curtis", ", p AS (SELECT feature, sample, value * 100 / sum(value) OVER (PARTITION BY sample) AS p FROM counts), s AS (SELECT DISTINCT sample AS s FROM counts) SELECT x.s AS a, y.s AS b, round(1 - coalesce((SELECT sum(least(m.p, n.p)) FROM p m JOIN p n USING (feature) WHERE m.sample = x.s AND n.sample = y.s), 0) / 100, 6) AS distance FROM s x, s y WHERE x.s < y.s", "counts")
def _(v):
    return C.bray_curtis(v("counts")).withColumn("distance", r6("distance"))


@query("c4_pca_scores")
def _(v):
    return C.pca_scores(v("counts"))[0]


@query("n11_remove_batch_components")
def _(v):
    return C.remove_batch_components(v("counts"), v("sheet")).withColumn("value", r6("value"))


@query("c5_pca_elbow")
def _(v):
    return C.pca_elbow(C.pca_scores(v("counts"))[1])


@query("c6_pcoa")
def _(v):
    return C.pcoa(C.bray_curtis(v("counts")))[0]


@query("c7_knn_graph")
def _(v):
    return C.knn_graph(C.pca_scores(v("counts"), 5)[0], 3)


@query("c8_graph_communities")
def _(v):
    return C.graph_communities(C.knn_graph(C.pca_scores(v("counts"), 5)[0], 3))


@query("e1_notes_section", "SELECT conv_id, turn, trim(string_split(role || ' ### Notes ' || text, '### Notes')[-1]) AS notes FROM conversations")
def _(v):
    c = v("conversations")
    return c.select("conv_id", "turn", E.notes_section(F.concat("role", F.lit(" ### Notes "), "text")).alias("notes"))


@query("e2_bullet_lines", r"SELECT doc_id, unnest(list_filter([trim(x) FOR x IN string_split(text, chr(10))], lambda x: x <> '')) AS line FROM documents")
def _(v):
    t = F.concat(F.lit("x<assistant> <summary>"), "text", F.lit("</summary> y"))
    return v("documents").select("doc_id", F.explode(E.bullet_lines(t)).alias("line"))


@query("e3_match_tags", "SELECT query_id, tag_id, round(s, 6) AS similarity FROM (SELECT a.vec_id AS query_id, b.label AS tag_id, list_sum([CAST(a.embedding[i] AS DOUBLE) * b.e[i] FOR i IN range(1, 65)]) / sqrt(list_sum([CAST(a.embedding[i] AS DOUBLE) ** 2 FOR i IN range(1, 65)]) * list_sum([b.e[i] ** 2 FOR i IN range(1, 65)])) AS s FROM embeddings a, (SELECT label, [avg(CAST(embedding[i] AS DOUBLE)) FOR i IN range(1, 2)] AS z, arg_min([CAST(x AS DOUBLE) FOR x IN embedding], vec_id) AS e FROM embeddings GROUP BY label) b) WHERE round(s, 6) >= 0.5".replace("[avg(CAST(embedding[i] AS DOUBLE)) FOR i IN range(1, 2)] AS z, ", ""))
def _(v):
    e = v("embeddings")
    tags = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.col("label").alias("tag_id"), "embedding")
    return E.match_tags(e.select(F.col("vec_id").alias("query_id"), "embedding"), tags, 0.4999995).withColumn("similarity", r6("similarity"))


@query("e4_select_labels", "SELECT l_orderkey AS text_id, array_to_string(list_sort(list_distinct(list(l_returnflag))), ';') AS labels FROM lineitem WHERE l_tax >= 0.05 GROUP BY 1")
def _(v):
    s = v("lineitem").select(F.col("l_orderkey").alias("text_id"), F.col("l_returnflag").alias("label"), F.col("l_tax").alias("score"))
    return E.select_labels(s, 0.05).withColumn("labels", F.array_join("labels", ";"))


@query("e5_select_resources", "SELECT DISTINCT p_name AS software, array_to_string(list_filter(['LARGE', 'PROMO'], lambda x: list_contains([p_type, p_brand], x)), '_') AS folder, 'git@' || p_brand AS location, 'clone' AS action FROM part WHERE p_type IN ('LARGE', 'PROMO') AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#1', 'Brand#2')")
def _(v):
    m = v("part").select(F.col("p_name").alias("software"), F.concat_ws("; ", "p_type", "p_brand").alias("scope_of_work"), F.col("p_brand").alias("description"), F.concat(F.lit("git@"), "p_brand").alias("location"))
    return E.select_resources(m, ["LARGE", "PROMO"], ["Brand#11", "Brand#12", "Brand#1", "Brand#2"])


@query("e6_unknown_scopes", "SELECT unnest(['src1', 'nowhere']) AS tag EXCEPT SELECT source FROM documents")
def _(v):
    return E.unknown_scopes(["src1", "nowhere"], v("documents").select(F.col("source").alias("tag")).distinct())


def _reads(v):
    return v("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("contig"), F.col("text").alias("seq"))


@query("g1_distinct_kmers", "SELECT DISTINCT substr(text, CAST(i AS INT), 6) AS kmer FROM (SELECT text, unnest(range(1, length(text) - 4)) AS i FROM benchmark)")
def _(v):
    return G.distinct_kmers(_reads(v), 6)


_KMERS = "SELECT item_id, i - 1 AS pos, substr({0}, CAST(i AS INT), {1}) AS kmer FROM (SELECT item_id, {0}, unnest(range(1, length({0}) - {1} + 2)) AS i FROM {2})"
_EQUAL = "list_sum([CASE WHEN substr({0}, CAST(i + 1 AS INT), 1) = substr({1}, CAST(i + {2} + 1 AS INT), 1) THEN 1 ELSE 0 END FOR i IN range({3}, {4})])"


@query("g2_kmer_anchors", f"""WITH k AS ({_KMERS.format("text", 12, "benchmark")}), s AS (SELECT item_id, kmer, min(pos) AS at FROM k GROUP BY 1, 2),
r AS (SELECT q.item_id AS q, s.item_id AS s, s.at - q.pos AS o, count(*) AS anchors, min(q.pos) AS a, max(q.pos) + 12 AS b FROM k q JOIN s USING (kmer) GROUP BY 1, 2, 3 HAVING count(*) >= 3),
m AS (SELECT r.*, length(x.text) AS n, {_EQUAL.format("x.text", "y.text", "o", "a", "b")} AS m FROM r JOIN benchmark x ON x.item_id = q JOIN benchmark y ON y.item_id = s)
SELECT 'b' || q AS query, 'b' || s AS subject, o AS offset, anchors, a AS start, b AS stop, CAST(m AS BIGINT) AS matches, round((b - a) / n, 6) AS coverage, round(m / (b - a), 6) AS identity, CAST(2 * m - (b - a) AS DOUBLE) AS score FROM m""")
def _(v):
    return G.kmer_anchors(_reads(v), _reads(v), 12, 3).withColumns({"coverage": r6("coverage"), "identity": r6("identity")})


# Reads that lose and gain bases, so that their runs lie at several offsets of the read they come from.
@query("g2_anchor_alignment", f"""WITH e AS (SELECT item_id, text, replace(text, 'the', 'th') AS read FROM benchmark), k AS ({_KMERS.format("text", 10, "e")}), l AS ({_KMERS.format("read", 10, "e")}), s AS (SELECT item_id, kmer, min(pos) AS at FROM k GROUP BY 1, 2),
r AS (SELECT item_id, s.at - l.pos AS o, min(l.pos) AS a, max(l.pos) + 10 AS b FROM l JOIN s USING (item_id, kmer) GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT item_id, pos, max(o) AS o FROM (SELECT item_id, o, unnest(range(a, b)) AS pos FROM r) GROUP BY 1, 2),
m AS (SELECT item_id, length(read) AS n, count(*) AS alln, sum(CASE WHEN substr(read, CAST(pos + 1 AS INT), 1) = substr(text, CAST(pos + o + 1 AS INT), 1) THEN 1 ELSE 0 END) AS m, max(pos) - min(pos) + 1 AS length FROM p JOIN e USING (item_id) GROUP BY item_id, read)
SELECT 'b' || item_id AS query, length, round(100 * alln / n, 6) AS coverage, round(100 * m / length, 6) AS identity, CAST(2 * m - alln AS DOUBLE) AS score, round((2 * m - alln) * length / n, 6) AS normalised FROM m""")
def _(v):
    r = _reads(v)
    edited = r.withColumn("seq", F.replace(F.col("seq"), F.lit("the"), F.lit("th")))
    runs = G.kmer_anchors(edited, r, 10, 2).where("query = subject")
    t = G.anchor_alignment(runs, edited, r)
    return t.select("query", "length", "score", *[r6(c).alias(c) for c in ("coverage", "identity", "normalised")])


# The reads lose three bases at each full stop and change bases before it, which leaves gaps between runs of neighbouring offsets.
@query("g3_fill_anchor_gaps", f"""WITH e AS (SELECT item_id, text, replace(replace(text, '. ', '.'), ' of ', ' 0f 1 ') AS read FROM benchmark), k AS ({_KMERS.format("text", 10, "e")}), l AS ({_KMERS.format("read", 10, "e")}), s AS (SELECT item_id, kmer, min(pos) AS at FROM k GROUP BY 1, 2),
r AS (SELECT item_id, s.at - l.pos AS o, min(l.pos) AS a, max(l.pos) + 10 AS b FROM l JOIN s USING (item_id, kmer) GROUP BY 1, 2 HAVING count(*) >= 2),
g AS (SELECT item_id, b AS f, nx AS t, b + o AS sf, nx + no AS st FROM (SELECT *, lead(a) OVER w AS nx, lead(o) OVER w AS no FROM r WINDOW w AS (PARTITION BY item_id ORDER BY a, o)) WHERE nx - b >= 3 AND nx + no > b + o AND b + o >= 0),
c AS (SELECT item_id, f, substr(read, CAST(f + 1 AS INT), CAST(t - f AS INT)) AS q, substr(text, CAST(sf + 1 AS INT), CAST(st - sf AS INT)) AS s FROM g JOIN e USING (item_id)),
x AS (SELECT item_id, f, i - 1 AS pos, substr(q, CAST(i AS INT), 3) AS kmer FROM (SELECT *, unnest(range(1, length(q) - 1)) AS i FROM c)), y AS (SELECT item_id, f, kmer, min(pos) AS at FROM (SELECT item_id, f, i - 1 AS pos, substr(s, CAST(i AS INT), 3) AS kmer FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM c)) GROUP BY ALL)
SELECT 'b' || item_id AS query, f + min(pos) AS start, f + max(pos) + 3 AS stop, count(*) AS anchors FROM x JOIN y USING (item_id, f, kmer) GROUP BY item_id, f, y.at - pos""")
def _(v):
    r = _reads(v)
    changed = F.replace(F.replace(F.col("seq"), F.lit(". "), F.lit(".")), F.lit(" of "), F.lit(" 0f 1 "))
    edited = r.withColumn("seq", changed)
    return G.fill_anchor_gaps(G.kmer_anchors(edited, r, 10, 2).where("query = subject"), edited, r, 3).drop("subject")


@query("g4_gapless_overlap", """WITH p AS (SELECT x.item_id AS pair, x.text AS a, y.text AS b, length(x.text) AS na, length(y.text) AS nb FROM benchmark x JOIN benchmark y ON y.item_id - 1 = x.item_id), o AS (SELECT *, greatest(0, -o) AS f, least(na, nb - o) AS t FROM (SELECT *, unnest(range(-(na - 5), nb - 5 + 1)) AS o FROM p WHERE na >= 5 AND nb >= 5)),
c AS (SELECT pair, o, i, CASE WHEN substr(a, CAST(i + 1 AS INT), 1) = substr(b, CAST(i + o + 1 AS INT), 1) THEN 1 ELSE -1 END AS v FROM (SELECT *, unnest(range(f, t)) AS i FROM o WHERE t - f >= 5)), s AS (SELECT pair, o, CAST(sum(v) AS BIGINT) AS score FROM c GROUP BY 1, 2), b AS (SELECT pair, o FROM s QUALIFY row_number() OVER (PARTITION BY pair ORDER BY score DESC, abs(o), o DESC) = 1),
r AS (SELECT pair, o, i, CAST(sum(v) OVER (PARTITION BY pair ORDER BY i) AS BIGINT) AS upto, v FROM c JOIN b USING (pair, o)), e AS (SELECT x.pair, x.o, x.upto - (y.upto - y.v) AS score, x.i AS stop, y.i AS start FROM r x JOIN r y ON x.pair = y.pair AND y.i <= x.i - 4),
m AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY pair, stop ORDER BY score DESC, start) = 1) SELECT pair, o AS offset, score, start, stop + 1 AS stop FROM m QUALIFY row_number() OVER (PARTITION BY pair ORDER BY score DESC, stop DESC, start DESC) = 1""")
def _(v):
    one = v("benchmark").select(F.col("item_id").alias("pair"), F.col("text").alias("a"))
    two = v("benchmark").select((F.col("item_id") - 1).alias("pair"), F.col("text").alias("b"))
    return G.gapless_overlap(one.join(two, "pair"))


@query("g5_promoter_windows", "SELECT doc_id AS gene, substr(text, CAST(greatest(0, 40 - 30) + 1 AS INT), CAST(40 + 10 - greatest(0, 40 - 30) AS INT)) AS promoter FROM documents")
def _(v):
    d = v("documents")
    genes = d.select(F.col("doc_id").alias("gene"), F.col("doc_id").cast("string").alias("chrom"), F.lit("+").alias("strand"), F.lit(40).alias("start"), F.lit(60).alias("stop"))
    return G.promoter_windows(genes, d.select(F.col("doc_id").cast("string").alias("contig"), F.col("text").alias("seq")), 30, 10).select("gene", "promoter")


def _tracks(v):
    return v("regions").select("chrom", (F.col("region") % 3).cast("int").alias("sample"), F.col("start").alias("from"), F.col("stop").alias("to"), (F.col("region") % 7).cast("double").alias("value"))


def _genes(v):
    return v("part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 22).cast("int").alias("chrom"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("p_partkey") * 7 % 2500).cast("int").alias("start"), (F.col("p_partkey") * 7 % 2500 + F.col("p_size")).cast("int").alias("stop"))


_GENES = "SELECT p_partkey AS gene, CAST(p_size % 22 AS INT) AS chrom, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(p_partkey * 7 % 2500 AS INT) AS start, CAST(p_partkey * 7 % 2500 + p_size AS INT) AS stop FROM part"
_TRACKS = "SELECT chrom, CAST(region % 3 AS INT) AS sample, start AS f, stop AS t, CAST(region % 7 AS DOUBLE) AS value FROM regions"


@query("g6_tss_profile", f", g AS (SELECT *, CASE WHEN strand = '-' THEN stop ELSE start END AS tss FROM ({_GENES})), k AS ({_TRACKS}) SELECT CASE WHEN strand = '-' THEN tss - pos ELSE pos - tss END AS relative, round(sum(value) / ((SELECT count(*) FROM g) * (SELECT count(DISTINCT sample) FROM k)), 6) AS value FROM (SELECT strand, tss, value, unnest(range(greatest(greatest(0, tss - 20), f), least(tss + 20, t) + 1)) AS pos FROM g JOIN k ON g.chrom = k.chrom AND greatest(0, tss - 20) <= t AND f <= tss + 20) GROUP BY 1", "regions")
def _(v):
    return G.tss_profile(_tracks(v), _genes(v), 20).withColumn("value", r6("value"))


@query("g7_region_coverage", f", g AS ({_GENES}), k AS ({_TRACKS}) SELECT gene AS region, sample % 2 AS condition, pos, median(value) AS value FROM (SELECT gene, sample, value, unnest(range(greatest(start, f), least(stop, t) + 1)) AS pos FROM g JOIN k ON g.chrom = k.chrom AND start <= t AND f <= stop) GROUP BY 1, 2, 3", "regions")
def _(v):
    groups = v.spark.range(3).select(F.col("id").cast("int").alias("sample"), (F.col("id") % 2).alias("condition"))
    return G.region_coverage(_tracks(v), _genes(v).withColumnRenamed("gene", "region"), groups)


@query("g8_region_of_gene", f"SELECT gene, chrom, greatest(0, least(start, coalesce(s, start)) - 50) AS start, greatest(stop, coalesce(e, stop)) + 50 AS stop FROM ({_GENES}) LEFT JOIN (SELECT l_partkey AS gene, min(l_suppkey * 10) AS s, max(l_suppkey * 10 + 5) AS e FROM lineitem WHERE l_tax < 0.05 GROUP BY 1) USING (gene)")
def _(v):
    peaks = v("lineitem").select(F.col("l_partkey").alias("gene"), (F.col("l_suppkey") * 10).alias("start"), (F.col("l_suppkey") * 10 + 5).alias("stop"), F.col("l_tax").alias("padj"))
    return G.region_of_gene(_genes(v), peaks, 50)


@query("g9_methylation_tss_bins", f", g AS ({_GENES}), d AS (SELECT chrom, pos, CAST(sum(meth - unmeth) AS DOUBLE) AS difference FROM calls GROUP BY 1, 2) SELECT gene, floor((pos - start) / 10.0) AS bin, round(avg(difference), 6) + 0.0 AS value FROM g JOIN d ON g.chrom = d.chrom AND pos BETWEEN start - 40 AND start + 40 GROUP BY 1, 2", "calls")
def _(v):
    d = v("calls").groupBy("chrom", "pos").agg(F.sum(F.col("meth") - F.col("unmeth")).cast("double").alias("difference"))
    return G.methylation_tss_bins(d, _genes(v), 40, 10).withColumn("value", r6("value"))


@query("g11_allele_keys", "SELECT concat(chrom, ':', pos, ':', ref) AS key, pos, id FROM variants", "variants")
def _(v):
    k = G.encode_allele(F.col("chrom"), F.col("pos"), F.col("ref"))
    return v("variants").select(k.alias("key"), G.decode_allele(k)["pos"].alias("pos"), "id")


@query("g12_genotype_alleles", "SELECT chrom, pos + i AS pos, allele, substr(CASE WHEN allele = 0 THEN ref ELSE alt END, CAST(i + 1 AS INT), 1) AS base FROM variants, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS allele) WHERE length(CASE WHEN allele = 0 THEN ref ELSE alt END) = length(ref) AND i < length(ref)", "variants")
def _(v):
    return G.genotype_alleles(v("variants"))


@query("g13_reverse_complement", "SELECT pos, id, translate(reverse(upper(ref || alt)), 'ACGT', 'TGCA') AS rc FROM variants", "variants")
def _(v):
    return v("variants").select("pos", "id", G.reverse_complement(F.concat("ref", "alt")).alias("rc"))


@query("g14_gene_exons", "SELECT l_partkey AS isoform, l_orderkey AS start, s.sample, CASE s.sample WHEN 's0' THEN p_retailprice ELSE p_size END AS expression FROM lineitem JOIN part ON l_partkey = p_partkey, (SELECT unnest(['s0', 's1']) AS sample) s")
def _(v):
    iso = v("part").select(F.col("p_partkey").alias("isoform"), F.col("p_retailprice").alias("s0"), F.col("p_size").cast("double").alias("s1"))
    return G.gene_exons(v("lineitem").select(F.col("l_partkey").alias("isoform"), F.col("l_orderkey").alias("start")), iso, ["s0", "s1"])


def _folder(v) -> str:
    return f"{shared_folder(v.spark)}/files-{uuid.uuid4().hex}"


@query("s1_read_write_table", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def _(v):
    path = _folder(v) + ".tsv"
    S.write_table(v("orders").select("o_orderkey", "o_orderpriority"), path)
    return S.read_table(v.spark, path)


@query("s2_read_gtf", "SELECT chrom, start, stop, strand, gene_id, gene_name FROM annotation WHERE strand = '+'", "annotation")
def _(v):
    a = v("annotation").withColumn("feature", F.when(F.col("strand") == "+", "gene").otherwise("exon"))
    line = S.as_gtf_line({c: F.col(c) for c in ("chrom", "feature", "start", "stop", "strand")}, {"gene_id": F.col("gene_id"), "gene_name": F.col("gene_name")})
    a.select(line.alias("value")).write.text(path := _folder(v))
    return S.read_gtf(v.spark, path, ["gene"]).select("chrom", "start", "stop", "strand", "gene_id", "gene_name")


@query("s3_read_vcf", "SELECT chrom, pos, ref, alt, CAST(CAST(dp AS INT) AS VARCHAR) AS dp, CAST(sample AS VARCHAR) AS gt FROM variants", "variants")
def _(v):
    head = v.spark.range(1).select(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1").alias("value"))
    body = v("variants").select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("id").cast("string"), "ref", "alt", F.col("qual").cast("string"), F.lit("PASS"), F.concat(F.lit("DP="), F.col("dp").cast("int").cast("string"), F.lit(";DB")), F.lit("GT:DP"), F.concat(F.col("sample").cast("string"), F.lit(":7"))).alias("value"))
    head.union(body).write.text(path := _folder(v))
    return S.read_vcf(v.spark, path).select("chrom", "pos", "ref", "alt", F.col("info")["DP"].alias("dp"), F.col("samples")[0]["values"]["GT"].alias("gt"))


@query("s4_s12_fasta", "SELECT 'b' || item_id AS contig, replace(text, chr(10), '') AS seq FROM benchmark")
def _(v):
    seqs = _reads(v).withColumn("seq", F.regexp_replace("seq", "\n", ""))
    S.write_fasta_per_contig(seqs, path := _folder(v))
    return S.read_fasta(v.spark, path + "/*")


@query("s4_fasta_chunks", "SELECT 'b' || item_id AS contig, i AS chunk, substr(seq, CAST(64 * i + 1 AS INT), 64) AS seq FROM (SELECT item_id, seq, unnest(range(CAST(ceil(length(seq) / 64) AS BIGINT))) AS i FROM (SELECT item_id, replace(text, chr(10), '') AS seq FROM benchmark))")
def _(v):
    seqs = _reads(v).withColumn("seq", F.regexp_replace("seq", "\n", ""))
    S.write_fasta_per_contig(seqs, path := _folder(v), 32)
    return S.read_fasta_chunks(v.spark, path + "/*", 64).select("contig", "chunk", "seq")


@query("g1_kmers_of_chunks", "SELECT DISTINCT substr(text, CAST(i AS INT), 9) AS kmer FROM (SELECT text, unnest(range(1, length(text) - 7)) AS i FROM (SELECT replace(text, chr(10), '') AS text FROM benchmark))")
def _(v):
    seqs = _reads(v).withColumn("seq", F.regexp_replace("seq", "\n", ""))
    S.write_fasta_per_contig(seqs, path := _folder(v), 50)
    return G.distinct_kmers(S.read_fasta_chunks(v.spark, path + "/*", 100), 9)


@query("s5_read_obo", "SELECT concat('N:', n_nationkey) AS id, n_name AS name, concat('R:', n_regionkey) AS parents FROM nation WHERE n_nationkey <> 3")
def _(v):
    n = v("nation")
    text = F.concat(F.lit("[Term]\nid: N:"), F.col("n_nationkey").cast("string"), F.lit("\nname: "), "n_name", F.lit("\nnamespace: geo\nis_a: R:"), F.col("n_regionkey").cast("string"), F.lit(" ! region"), F.when(F.col("n_nationkey") == 3, "\nis_obsolete: true").otherwise(""))
    n.select(text.alias("value")).write.option("lineSep", "\n\n").text(path := _folder(v))
    return S.read_obo(v.spark, path, "geo").select("id", "name", F.array_join("parents", ";").alias("parents"))


@query("s6_read_kraken_report", "SELECT CAST(1.5 AS DOUBLE) AS percent, l_orderkey AS fragments, CAST(1 AS BIGINT) AS direct, 'S' AS rank, CAST(l_partkey AS VARCHAR) AS taxid, 'name' AS name FROM lineitem WHERE l_linenumber % 2 = 0 AND l_orderkey > 0 AND l_partkey <> 5")
def _(v):
    line = F.concat_ws("\t", F.lit(" 1.5"), F.col("l_orderkey").cast("string"), F.lit("1"), F.when(F.col("l_linenumber") % 2 == 0, "S").otherwise("G"), F.col("l_partkey").cast("string"), F.lit("   name"))
    v("lineitem").select(line.alias("value")).write.text(path := _folder(v))
    return S.read_kraken_report(v.spark, path, ["S"], ["5"]).drop("sample")


@query("s7_read_taxdump", "SELECT c_custkey AS taxid, c_name AS name, CAST(c_nationkey AS BIGINT) AS parent, c_mktsegment AS rank FROM customer")
def _(v):
    dump = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|")).alias("value")
    k = F.col("c_custkey").cast("string")
    v("customer").select(dump(k, F.col("c_name"))).write.text(names := _folder(v))
    v("customer").select(dump(k, F.col("c_nationkey").cast("string"), F.col("c_mktsegment"))).write.text(nodes := _folder(v))
    first, tree = S.read_taxdump(v.spark, names, nodes)
    return first.join(tree.withColumnRenamed("child", "taxid"), "taxid").select("taxid", "name", "parent", "rank")


@query("s8_read_bedgraph", "SELECT CAST(chrom AS VARCHAR) AS chrom, start, stop, CAST(region % 9 AS DOUBLE) AS coverage FROM regions", "regions")
def _(v):
    v("regions").select("chrom", "start", "stop", (F.col("region") % 9).alias("c")).write.csv(path := _folder(v), sep="\t")
    return S.read_bedgraph(v.spark, path)


@query("s9_read_comparison_design", "SELECT 'test' AS name, CAST(sample AS VARCHAR) AS sample, condition FROM sheet", "sheet")
def _(v):
    head = v.spark.createDataFrame([(0, "ComparisonName\ttest"), (1, "Reference\tA"), (2, "sample\tcondition")], "k long, value string")
    rows = v("sheet").select((F.col("sample") + 3).cast("long").alias("k"), F.concat_ws("\t", F.col("sample").cast("string"), "condition").alias("value"))
    head.union(rows).coalesce(1).sortWithinPartitions("k").select("value").write.text(path := _folder(v))
    keys, table = S.read_comparison_design(v.spark, path)
    return table.select(F.lit(keys["ComparisonName"]).alias("name"), "sample", "condition")


@query("s10_merge_sample_files", "SELECT CAST(feature AS VARCHAR) AS feature, sum(value) AS value FROM counts GROUP BY 1", "counts")
def _(v):
    v("counts").select(F.concat_ws("\t", F.col("feature").cast("string"), F.col("value").cast("string")).alias("value")).write.text(path := _folder(v))
    return S.merge_sample_files(v.spark, path).groupBy("feature").agg(F.sum("value").alias("value"))


@query("s13_parse_gene_sets", "SELECT DISTINCT 'H' AS set, p_brand AS gene FROM part")
def _(v):
    genes = v("part").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("g"))
    lines = genes.select(F.explode(F.array(F.lit("STANDARD_NAME\tH"), F.concat(F.lit("GENE_SYMBOLS\t"), "g"))).alias("value"))
    lines.coalesce(1).write.text(path := _folder(v))
    return S.parse_gene_sets(v.spark, path)
