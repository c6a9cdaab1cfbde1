"""Domain shapes as views over the given tables: Spark frames, and the same as SQL for checks.

Operators take column names and know nothing of these bindings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Every view is a SQL text that Spark and DuckDB read alike; views may build on earlier ones.
SQL = {
    "counts": "SELECT l_partkey AS feature, CAST(l_suppkey % 12 AS INT) AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY l_partkey, l_suppkey % 12",
    "sheet": "SELECT DISTINCT CAST(s_suppkey % 12 AS INT) AS sample, CASE WHEN s_suppkey % 12 % 2 = 0 THEN 'A' ELSE 'B' END AS condition, CAST(s_suppkey % 12 % 3 AS INT) AS batch FROM supplier",
    "de": "SELECT CAST(l_partkey AS VARCHAR(20)) AS gene_symbol, ln((sum(CASE WHEN l_suppkey % 2 = 1 THEN l_quantity ELSE 0 END) + 1) / (sum(CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE 0 END) + 1)) / ln(2) AS log2FoldChange, exp(-abs(sum(CASE WHEN l_suppkey % 2 = 1 THEN l_quantity ELSE -l_quantity END)) / 60) AS pvalue, least(1.0, 2 * exp(-abs(sum(CASE WHEN l_suppkey % 2 = 1 THEN l_quantity ELSE -l_quantity END)) / 60)) AS padj FROM lineitem GROUP BY l_partkey",
    "de2": "SELECT CAST(l_partkey AS VARCHAR(20)) AS gene_symbol, ln((sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) + 1) / (sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) + 1)) / ln(2) AS log2FoldChange, exp(-abs(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity WHEN l_returnflag = 'A' THEN -l_quantity ELSE 0 END)) / 60) AS pvalue, least(1.0, 2 * exp(-abs(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity WHEN l_returnflag = 'A' THEN -l_quantity ELSE 0 END)) / 60)) AS padj FROM lineitem GROUP BY l_partkey",
    "t2g": "SELECT p_type AS category, CAST(p_partkey AS VARCHAR(20)) AS gene_symbol FROM part",
    "genes": "SELECT CAST(l_partkey AS VARCHAR(20)) AS gene_symbol FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > (SELECT sum(l_quantity) / count(DISTINCT l_partkey) FROM lineitem)",
    "annotation": "SELECT CAST(p_partkey AS VARCHAR(20)) AS gene_id, p_name AS gene_name, p_brand AS biotype, concat('chr', CAST(p_size % 22 + 1 AS VARCHAR(9))) AS chrom, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(p_partkey * 100 AS INT) AS start, CAST(p_partkey * 100 + p_size * 10 AS INT) AS stop FROM part",
    "edges": "SELECT concat('R', CAST(n_regionkey AS VARCHAR(20))) AS parent, concat('N', CAST(n_nationkey AS VARCHAR(20))) AS child FROM nation UNION ALL SELECT concat('N', CAST(s_nationkey AS VARCHAR(20))), concat('S', CAST(s_suppkey AS VARCHAR(20))) FROM supplier UNION ALL SELECT concat('N', CAST(c_nationkey AS VARCHAR(20))), concat('C', CAST(c_custkey AS VARCHAR(20))) FROM customer",
    "regions": "SELECT CAST(o_orderkey AS BIGINT) AS region, CAST(o_custkey % 22 AS INT) AS chrom, CAST(datediff_days AS INT) AS start, CAST(datediff_days + o_orderkey % 30 AS INT) AS stop FROM order_days",
    "points": "SELECT CAST(l_suppkey % 22 AS INT) AS chrom, CAST(ship_day AS INT) AS pos, CAST(l_suppkey % 4 AS INT) AS sample, l_quantity AS value FROM ship_days",
    "calls": "SELECT CAST(l_suppkey % 22 AS INT) AS chrom, CAST(ship_day AS INT) AS pos, CAST(l_suppkey % 4 AS INT) AS sample, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS meth, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS unmeth FROM ship_days GROUP BY l_suppkey % 22, ship_day, l_suppkey % 4",
    "variants": "SELECT concat('chr', CAST(l_suppkey % 22 + 1 AS VARCHAR(9))) AS chrom, l_orderkey AS pos, CAST(l_linenumber AS INT) AS id, substr('ACGTACAGTTGCA', CAST(l_partkey % 11 + 1 AS INT), CAST(1 + l_partkey % 3 % 2 AS INT)) AS ref, substr('TGCATTACGGACT', CAST(l_partkey % 7 + 1 AS INT), CAST(1 + l_suppkey % 5 % 2 AS INT)) AS alt, l_extendedprice / 1000 AS qual, l_quantity AS dp, l_discount AS af, CAST(l_suppkey % 12 AS INT) AS sample FROM lineitem",
    "junctions": "SELECT CAST(l_suppkey % 12 AS INT) AS sample, CAST(l_partkey % 500 AS INT) AS start, CAST(l_partkey % 500 + 10 + l_linenumber AS INT) AS stop, sum(l_quantity) AS reads FROM lineitem GROUP BY l_suppkey % 12, l_partkey % 500, l_partkey % 500 + 10 + l_linenumber",
    "profile": "SELECT CAST(l_suppkey % 12 AS INT) AS sample, p_brand AS clade, p_type AS species, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey % 12, p_brand, p_type",
}
_DAYS = {
    "order_days": ("SELECT *, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS datediff_days FROM orders", "SELECT *, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS datediff_days FROM orders"),
    "ship_days": ("SELECT *, datediff(CAST(l_shipdate AS DATE), DATE '1992-01-01') AS ship_day FROM lineitem", "SELECT *, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS ship_day FROM lineitem"),
}
_USES = {"regions": ["order_days"], "points": ["ship_days"], "calls": ["ship_days"]}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations benchmark pages".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a table by its own name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = f" {SQL[name]} "
    with_days = {k: _DAYS[k][0] for k in _USES.get(name, [])}
    ctes = ", ".join(f"{k} AS ({q})" for k, q in with_days.items())
    whole = f"WITH {ctes} {text}" if ctes else text
    frames = {}
    for t in TABLES:
        padded = whole.replace("(", " ( ").replace(")", " ) ").replace(",", " , ")
        if f" {t} " in padded.split("--")[0] + " ":
            frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            for lead in ("FROM ", "JOIN "):
                whole = whole.replace(f"{lead}{t} ", f"{lead}{{{t}}} ").replace(f"{lead}{t})", f"{lead}{{{t}}})")
    return spark.sql(whole, **frames)


def ctes(*names: str) -> str:
    """``WITH`` clause that defines views for a DuckDB query."""
    parts = []
    for n in names:
        for d in _USES.get(n, []):
            parts.append(f"{d} AS ({_DAYS[d][1]})")
        parts.append(f"{n} AS ({SQL[n]})")
    return "WITH RECURSIVE " + ", ".join(dict.fromkeys(parts)) + " "
