"""Exact nearest neighbours of rows with a few numeric columns, and principal components of columns.

Equal vectors are one vector from the start, with their first rows only, so however many copies a value has, a search meets it
once. Vectors are dealt into slices by their first column and, within a slice, into blocks of ``BLOCK`` by the
second, so a task's share follows from sizes, not from values. The search has two rounds. The first looks into a
vector's own block and finds a distance within which there are enough rows. The second reads every block whose bounding
box is within that distance, and no other: the stop rule that keeps the result exact.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import settle

#: Vectors in a block.
BLOCK = 256
#: Decimals to which coordinates and squared distances count as equal, and what a distance is widened by for that.
DIGITS, SLACK = 9, 1e-7


def _square(columns: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [(x - y) * (x - y) for x, y in columns])


def _deal(vectors: DataFrame, dims: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """The vectors with their slice, block and ``vid``, written once; and each block's bounding box."""
    slices = max(1, math.ceil(math.sqrt(vectors.count() / block)))
    second = dims[1] if len(dims) > 1 else dims[0]
    dealt = vectors.repartitionByRange(slices, dims[0]).sortWithinPartitions(second, *dims)
    # The low 33 bits of the id are the place in the partition.
    place = F.monotonically_increasing_id()
    dealt = settle(dealt.withColumns({"vid": place, "slice": F.spark_partition_id(), "block": F.floor(place.bitwiseAND(2**33 - 1) / block)}), "vectors")
    boxes = dealt.groupBy("slice", "block").agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    return dealt, settle(boxes, "boxes")


def _radius(dealt: DataFrame, dims: list[str], wanted: int) -> DataFrame:
    """(vid, far): for each asking vector the squared distance that holds ``wanted`` rows of its own block; null if the block has fewer."""
    def within(rows: pd.DataFrame) -> pd.DataFrame:
        at, n = rows[dims].to_numpy(float), rows["n"].to_numpy()
        asks = np.flatnonzero(rows["asks"].to_numpy())
        out = np.full(len(asks), np.nan)
        if len(asks) and n.sum() >= wanted:
            far = ((at[asks][:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
            order = np.argsort(far, axis=1)
            place = (np.cumsum(n[order], axis=1) >= wanted).argmax(axis=1)
            out = far[np.arange(len(asks)), order[np.arange(len(asks)), place]]
        return pd.DataFrame({"vid": rows["vid"].to_numpy()[asks], "far": out})

    found = dealt.select("slice", "block", "vid", "n", "asks", *dims).groupBy("slice", "block").applyInPandas(within, "vid long, far double")
    return found.select("vid", F.when(~F.isnan("far"), F.col("far")).alias("far"))


def nearest(rows: DataFrame, key: str, dims: list[str], k: int, ask: Column | None = None, carry: list[str] = (), block: int = BLOCK) -> DataFrame:
    """(key, near): the ``k`` nearest other rows of each row that asks, by distance and then by key, with what they ``carry``.

    ``near`` is an array of (d2, key, carried columns), nearest first. Keys must be distinct; rows with a null
    coordinate are left out. An asking row has fewer neighbours only if the table has.
    """
    points = rows.select(F.col(key).alias("key"), *[(F.round(F.col(d).cast("double"), DIGITS) + F.lit(0.0)).alias(f"x{i}") for i, d in enumerate(dims)], F.struct(F.col(key).alias("key"), *carry).alias("row"), (F.lit(True) if ask is None else F.coalesce(ask, F.lit(False))).alias("asks"))
    xs = [f"x{i}" for i in range(len(dims))]
    points = settle(points.dropna(subset=xs), "points")
    vectors = settle(points.groupBy(*xs).agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("n"), F.max("asks").alias("asks")), "vectors")
    dealt, boxes = _deal(vectors, xs, block)
    asks = dealt.where("asks").join(_radius(dealt, xs, k + 1), "vid").select(F.col("vid").alias("ask"), *[F.col(x).alias(f"q_{x}") for x in xs], (F.coalesce("far", F.lit(float("inf"))) + SLACK).alias("far"))
    asks = settle(asks, "asks")
    reach = F.sqrt("far")
    # A slice is one range of the first coordinate; there are as many as the square root of the number of blocks.
    slices = F.broadcast(boxes.groupBy("slice").agg(F.min("lo_x0").alias("lo"), F.max("hi_x0").alias("hi")))
    met = asks.join(slices, (F.col("lo") <= F.col("q_x0") + reach) & (F.col("hi") >= F.col("q_x0") - reach)).drop("lo", "hi")
    gap = reduce(lambda a, b: a + b, [F.pow(F.greatest(F.col(f"lo_{x}") - F.col(f"q_{x}"), F.col(f"q_{x}") - F.col(f"hi_{x}"), F.lit(0.0)), 2) for x in xs])
    met = met.join(boxes, "slice").where(gap <= F.col("far")).select("ask", "far", *[f"q_{x}" for x in xs], "slice", "block")
    d2 = _square([(F.col(f"q_{x}"), F.col(x)) for x in xs])
    met = met.join(dealt.select("slice", "block", "vid", *xs), ["slice", "block"]).withColumn("d2", d2).where("d2 <= far").select("ask", F.round("d2", DIGITS).alias("d2"), "vid")
    # The first rows of a vector: Spark limits each task's rows of a vector before it shuffles them.
    some = points.withColumn("r", F.row_number().over(Window.partitionBy(*xs).orderBy("key"))).where(F.col("r") <= k + 1)
    some = some.join(dealt.select("vid", *xs), xs).select("vid", "row")
    found = met.join(some, "vid").select("ask", F.struct("d2", "row.*").alias("found"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy("found.d2", "found.key"))).where(F.col("r") <= k + 1)
    lists = found.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("r", "found"))).alias("found"))
    lists = dealt.select(F.col("vid").alias("ask"), *xs).join(lists, "ask")
    others = F.filter(F.transform("found", lambda f: f["found"]), lambda f: f["key"] != F.col("key"))
    return points.where("asks").join(lists, xs).select(F.col("key").alias(key), F.slice(others, 1, k).alias("near"))


def principal_axes(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(variances in falling order, axes as columns) of the covariance of a few columns; one scan, columns squared on the driver."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    s = df.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{n}") for n, (i, j) in enumerate(pairs)]).first()
    cov = np.zeros((len(columns), len(columns)))
    for n, (i, j) in enumerate(pairs):
        cov[i, j] = cov[j, i] = s[f"c{n}"] or 0.0
    values, vectors = np.linalg.eigh(cov)
    return values[::-1], vectors[:, ::-1]


def elbow(variances: np.ndarray) -> int:
    """How many components lie up to the place where the line from the first to the last is highest above them."""
    if len(variances) < 2:
        return len(variances)
    line = variances[0] + (variances[-1] - variances[0]) * np.arange(len(variances)) / (len(variances) - 1)
    return int(np.argmax(np.round(line - variances, 12))) + 1
