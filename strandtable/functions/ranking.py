"""Places and running sums over whole columns, without a task that sees a column whole.

Rows are cut into ``PIECES`` at quantiles of the value over all keys, so no (key, piece) holds more than a
piece of all rows, however hot a key is. Windows run within (key, piece); what lies between pieces comes
from one aggregate row for each (key, piece). The rows are written to the shared folder once, so that
these aggregates read a narrow table instead of repeating what made it; the driver sees the cuts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import settle

PIECES = 128


def with_piece(df: DataFrame, value: str, pieces: int = PIECES) -> DataFrame:
    """The settled rows with ``_piece``: how many of the column's quantiles are below the value. Values must not be null."""
    rows = settle(df)
    cuts = rows.agg(F.percentile_approx(value, [k / pieces for k in range(1, pieces)], 10000)).first()[0]
    at = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col(value))) if cuts else F.lit(0)
    return rows.withColumn("_piece", at)


def row_places(df: DataFrame, order: list[Column], keys: list[str], out: str) -> DataFrame:
    """Add ``out``: the row's place (from 0, gapless) in its key by ``order``; the rows are written once.

    Rows are range-partitioned by key and order, so neither a hot key nor one value that many rows share is one task
    as long as ``order`` tells its rows apart. A place is that in the partition plus the sizes of the key's earlier partitions.
    """
    sort = [*[F.col(k) for k in keys], *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    return join_on_keys(rows, sizes, [*keys, "_part"]).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(out))


def join_on_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Equi join that meets null keys too; the other side's keys go."""
    named = other.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return df.join(named, on).drop(*[f"_on_{k}" for k in keys])


def across_pieces(rows: DataFrame, keys: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add aggregates over a key's pieces: ``name`` over the earlier ones, ``name_later`` over the later, ``name_own`` over the own.

    Each total is a kind (sum, min or max) and the aggregate itself; null where there are no such pieces.
    """
    w = Window.partitionBy(*keys).orderBy("_piece")
    carry = {"sum": F.sum, "min": F.min, "max": F.max}
    sums = rows.groupBy(*keys, "_piece").agg(*[c.alias(f"{n}_own") for n, (_, c) in totals.items()])
    for n, (kind, _) in totals.items():
        own = carry[kind](f"{n}_own")
        sums = sums.withColumn(n, own.over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(f"{n}_later", own.over(w.rowsBetween(1, Window.unboundedFollowing)))
    return join_on_keys(rows, sums, [*keys, "_piece"])


def sum_below(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the key's smaller values. Rows must be distinct in (keys, value), values not null."""
    rows = with_piece(df, value)
    inner = F.sum(weight).over(Window.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    rows = across_pieces(rows, keys, {"_before": ("sum", F.sum(weight))}).withColumn("_inner", inner)
    zero = F.lit(0)
    return rows.withColumn(out, F.coalesce("_before", zero) + F.coalesce("_inner", zero)).select(*df.columns, out)


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the rank of the value in its key, ties at their mean. Rows without a value go.

    Equal values are counted before ranking, and the ranks are joined back.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = sum_below(counts, keys, value, "_n", "_below").select(*keys, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(out))
    return join_on_keys(df, ranks, [*keys, value])
