"""Helpers shared by the text operators: slices of batches, ranks over all rows, components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import drop_settled as drop_table
from ..functions.storage import settle as table
from ..functions.storage import shared_folder as shared_dir

__all__ = ["components", "drop_table", "first_by_weight", "ranked", "seeded", "shared_dir", "shuffle_parts", "slices", "table"]

#: Texts that a Python task works on at a time. Spark bounds the bytes of the batches that it hands over.
SLICE = 256


def slices(batches: Iterator[pd.DataFrame], rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """The batches in slices of a few rows; an empty batch is one slice."""
    for b in batches:
        for at in range(0, max(1, len(b)), rows):
            yield b.iloc[at : at + rows].reset_index(drop=True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[Column], within: list[str], tag: str) -> DataFrame:
    """Add ``rank`` (long, gapless from 0 in each group of ``within``) in the order of ``order``.

    Rows are range-partitioned by (``within``, ``order``), so one large group spreads over many tasks;
    a rank is the place in the own partition plus the sizes of the same group's earlier partitions.
    Only those sizes (at most partitions + groups rows) are put through a window. Ties beyond ``order``
    keep an arbitrary but fixed place.
    """
    keys = [F.col(k) for k in within]
    sort = [*keys, *order]
    placed = df.repartitionByRange(shuffle_parts(df.sparkSession), *sort).sortWithinPartitions(*sort)
    placed = table(placed.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()), tag)
    sizes = placed.groupBy("_pid", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sizes = sizes.select(F.col("_pid").alias("_p"), "_first", "_before", *[F.col(k).alias(f"_of_{k}") for k in within])
    on = F.col("_pid") == F.col("_p")
    for k in within:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = placed.join(sizes, on)
    return out.select(*df.columns, (F.col("_pos") - F.col("_first") + F.col("_before")).alias("rank"))


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b`` of one type) -> (``node``, ``component``).

    ``component`` is the smallest node of each. Alternating large-star and small-star rounds: each
    round is two group-minimum aggregations (combined before the shuffle) and equi joins, so neither
    a hub nor a chain is gathered in one task, and the rounds grow with the logarithm of the chains.
    Self loops give a node its own component; null ends are ignored.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null")
    now = table(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), tag)
    loops = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    mark = None
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = table(small.distinct(), tag)
        drop_table(now)
        now = after
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).union(loops).distinct().join(stars.select("node"), "node", "left_anti")
    return stars.union(roots.select("node", F.col("node").alias("component")))


def seeded(column: str, seed: int) -> Column:
    """A fixed random order: 32 hexadecimal digits for each value (null counts as empty)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary"))


def first_by_weight(rows: DataFrame, key: str, order: str, weight: str, quotas: dict) -> DataFrame:
    """Add ``picked``: of each key, the rows whose weights come first and reach its quota most nearly.

    Rows follow each other by ``order`` (hexadecimal digits as ``seeded`` makes them); a row is picked
    if the weight before it plus half its own is at most the quota. No key is sorted as a whole: sums
    by the first three digits find the group in which the quota ends, sums by the next three the group
    in that, and only its rows (a 16-millionth of the key) are put through a window. ``quotas`` has one
    number for each key, so its size is that of the key set, which callers bound.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    if not quotas:
        return rows.withColumn("picked", F.lit(False))
    rows = rows.withColumns({"_d1": F.substring(order, 1, 3), "_d2": F.substring(order, 4, 3)})
    plan = spark.createDataFrame([(k, int(q)) for k, q in quotas.items()], f"_k {kind}, _q long")

    def edge(sums: DataFrame, digit: str, start: Column) -> DataFrame:
        before = Window.partitionBy("_k").orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_b", start + F.coalesce(F.sum("_n").over(before), F.lit(0)))
        return sums.where("_b <= _q and _b + _n > _q").select("_k", "_q", F.col(digit).alias(f"_e{digit[-1]}"), "_b")

    at = F.broadcast(plan)
    sums = rows.groupBy(key, "_d1").agg(F.sum(weight).alias("_n")).join(at, F.col(key).eqNullSafe(F.col("_k")))
    one = edge(sums, "_d1", F.lit(0))
    one = spark.createDataFrame(one.collect(), one.schema)  # a row for each key at most
    inner = rows.join(F.broadcast(one), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_d1") == F.col("_e1")))
    sums = inner.groupBy("_k", "_q", "_b", "_e1", "_d2").agg(F.sum(weight).alias("_n")).withColumnRenamed("_b", "_s")
    two = edge(sums, "_d2", F.col("_s")).select("_k", "_e2", F.col("_b").alias("_b2"))
    two = spark.createDataFrame(two.collect(), two.schema)
    ends = plan.join(F.broadcast(one.drop("_q", "_b")), one["_k"].eqNullSafe(plan["_k"]), "left").select(plan["_k"], "_q", "_e1")
    ends = ends.join(F.broadcast(two), two["_k"].eqNullSafe(ends["_k"]), "left").select(ends["_k"], "_q", "_e1", "_e2", "_b2")
    ends = spark.createDataFrame(ends.collect(), ends.schema)
    marked = rows.join(F.broadcast(ends), F.col(key).eqNullSafe(F.col("_k")), "left")
    last = F.expr("_d1 = _e1 and _d2 = _e2")
    clear = marked.where(~F.coalesce(last, F.lit(False)))
    clear = clear.withColumn("picked", F.expr("coalesce(_e1 is null and _q > 0 or _d1 < _e1 or _d1 = _e1 and _d2 < _e2, false)"))
    before = Window.partitionBy(key).orderBy(order, weight).rowsBetween(Window.unboundedPreceding, -1)
    near = marked.where(last).withColumn("picked", (F.col("_b2") + F.coalesce(F.sum(weight).over(before), F.lit(0)) + F.col(weight) / 2) <= F.col("_q"))
    keep = [c for c in rows.columns if c not in ("_d1", "_d2")]
    return clear.select(*keep, "picked").union(near.select(*keep, "picked"))
