"""Diversity, ordination and neighbour graphs of profiles (feature or clade by sample)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import settle
from .matrix import complete
from .neighbours import nearest
from .statistics import kruskal_wallis

#: Samples that ``remove_batch_components`` takes, as it tests every component; features are never gathered.
MOST_SAMPLES = 4000


def shannon_index(m: DataFrame) -> DataFrame:
    t = m.where("value > 0").groupBy("sample").agg(F.sum("value").alias("_t"))
    p = F.col("value") / F.col("_t")
    return m.where("value > 0").join(t, "sample").groupBy("sample").agg(F.sum(-p * F.log(p)).alias("shannon"))


def log10_richness(m: DataFrame) -> DataFrame:
    return m.groupBy("sample").agg(F.log10(F.count_if(F.col("value") > 0)).alias("richness"))


def bray_curtis(m: DataFrame, feature: str = "feature") -> DataFrame:
    """(a, b, distance) of sample pairs on percents: 1 - sum of minima / 100."""
    t = m.groupBy("sample").agg(F.sum("value").alias("_t"))
    p = m.join(t, "sample").select(feature, "sample", (F.col("value") * 100 / F.col("_t")).alias("p"))
    left, right = p.select(feature, F.col("sample").alias("a"), F.col("p").alias("x")), p.select(feature, F.col("sample").alias("b"), F.col("p").alias("y"))
    shared = left.join(right, feature).where("a < b").groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("s"))
    s = m.select("sample").distinct()
    pairs = s.select(F.col("sample").alias("a")).join(s.select(F.col("sample").alias("b")), F.col("a") < F.col("b"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", (1 - F.coalesce("s", F.lit(0.0)) / 100).alias("distance"))


def _decompose(spark, gram: dict, names: list, k: int) -> tuple[DataFrame, DataFrame]:
    g = np.zeros((len(names), len(names)))
    at = {n: i for i, n in enumerate(names)}
    for (a, b), x in gram.items():
        g[at[a], at[b]] = g[at[b], at[a]] = x
    centre = np.eye(len(names)) - 1 / max(1, len(names))
    values, vectors = np.linalg.eigh(centre @ g @ centre)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    vectors *= np.where(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(names))] < 0, -1, 1)
    whole = values[values > 0].sum() or 1.0
    scores = vectors[:, :k] * np.sqrt(np.maximum(values[:k], 0))
    rows = [(n, int(j + 1), float(scores[i, j])) for i, n in enumerate(names) for j in range(min(k, len(names)))]
    parts = [(int(j + 1), float(max(v, 0) / whole)) for j, v in enumerate(values)]
    kind = "long" if names and isinstance(names[0], int) else "string"
    return spark.createDataFrame(rows, f"sample {kind}, component int, score double"), spark.createDataFrame(parts, "component int, explained double")


def _names(m: DataFrame) -> list:
    names = [r[0] for r in m.select("sample").distinct().orderBy("sample").limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"over {MOST_SAMPLES} samples")
    return names


def _triangle(rows: DataFrame, vector: str) -> np.ndarray:
    """R (square) of the QR decomposition of all rows of ``vector``: each task's R, and those of a few tasks each, meet in a tree."""
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for b in batches:
            if len(b):
                part = np.stack(b[vector].to_numpy())
                r = np.linalg.qr(part if r is None else np.vstack((r, part)), mode="r")
        if r is not None:
            yield pd.DataFrame({"task": [TaskContext.get().partitionId() // 32], "r": [r.ravel()]})

    wide = int(rows.select(F.size(vector)).first()[0])
    stack = lambda some: np.vstack([np.asarray(r).reshape(-1, wide) for r in some["r"]])
    tops = rows.select(vector).mapInPandas(local, "task int, r array<double>")
    tops = tops.groupBy("task").applyInPandas(lambda some: pd.DataFrame({"task": [0], "r": [np.linalg.qr(stack(some), mode="r").ravel()]}), "task int, r array<double>").toPandas()
    return np.linalg.qr(np.vstack((stack(tops), np.zeros((wide, wide)))), mode="r")


def leading_components(m: DataFrame, k: int, extra: int = 10, tolerance: float = 1e-12, most_rounds: int = 200, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(scores, explained shares) of the ``k`` leading principal components, for any number of samples and features.

    A random subspace of ``k + extra`` sample vectors is multiplied by the centred matrix and its transpose, in turn, until its
    leading variances stand still (randomised subspace iteration). Cells meet the narrow sample or feature vectors in equi
    joins; vectors are made orthonormal by tall-skinny QR, of which the driver sees matrices of that width alone. Absent
    cells are 0. Where samples or features are no more than the subspace, one round is exact. Fails if the variances do not settle.
    """
    cells = settle(m.where(F.col("value").isNotNull()).groupBy("feature", "sample").agg(F.sum("value").cast("double").alias("value")), "cells")
    n = cells.select("sample").distinct().count()
    wide = min(k + extra, n)
    kind = dict(cells.dtypes)["sample"]
    if not n:
        return (cells.sparkSession.createDataFrame([], x) for x in (f"sample {kind}, component int, score double", "component int, explained double"))
    sums = lambda vector: F.array(*[F.sum(F.col("value") * F.col(vector)[j]) for j in range(wide)])
    means = settle(cells.groupBy("feature").agg((F.sum("value") / n).alias("mean"), F.sum(F.col("value") ** 2).alias("square")), "means")
    whole = means.agg(F.sum(F.col("square") - n * F.col("mean") ** 2)).first()[0] or 0.0

    def by_sample(of_features: DataFrame) -> DataFrame:
        """(sample, v): the centred matrix times (feature, v)."""
        shift = means.join(of_features, "feature").agg(*[F.sum(F.col("mean") * F.col("v")[j]).alias(f"c{j}") for j in range(wide)]).first()
        found = cells.join(of_features, "feature").groupBy("sample").agg(sums("v").alias("v"))
        return settle(found.select("sample", F.array(*[F.col("v")[j] - float(shift[j] or 0.0) for j in range(wide)]).alias("v")), "by-sample")

    def by_feature(of_samples: DataFrame) -> DataFrame:
        """The transpose times (sample, v), whose sums are zero, so that the means drop out."""
        return settle(cells.join(of_samples, "sample").groupBy("feature").agg(sums("v").alias("v")), "by-feature")

    def turned(rows: DataFrame, by: np.ndarray) -> DataFrame:
        return rows.mapInPandas(lambda batches: (b.assign(v=list(np.stack(b["v"].to_numpy()) @ by)) for b in batches if len(b)), rows.schema)

    signs = lambda j: F.shiftright(F.xxhash64(F.lit(seed + j // 60), F.col("feature")), j % 60).bitwiseAND(F.lit(1).cast("long"))
    start = means.select("feature", F.array(*[(signs(j) * 2 - 1).cast("double") for j in range(wide)]).alias("v"))
    y, seen = by_sample(start), None
    for _ in range(most_rounds):
        u, d, v = np.linalg.svd(_triangle(y, "v"))
        good = d > 1e-13 * max(d[0], 1e-300)
        scale = np.where(good, 1 / np.where(good, d, 1.0), 0.0)
        q = settle(turned(y, v.T * scale), "basis")
        z = by_feature(q)
        triangle = _triangle(z, "v")
        turn, d, _ = np.linalg.svd(triangle.T)
        now = d[: min(k, wide)] ** 2
        if wide == n or seen is not None and np.all(np.abs(now - seen) <= tolerance * max(now[0], 1e-300)):
            break
        seen = now
        y = by_sample(z)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds; ask for fewer or allow more")
    kept = min(k, wide)
    scores = settle(turned(q, (turn * d)[:, :wide]), "scores")
    # The entry of the greatest size is positive, as far as its sign can be told.
    ends = scores.agg(*[F.max_by(F.col("v")[j], F.struct(F.round(F.abs(F.col("v")[j]), 9), -F.xxhash64("sample"))).alias(f"s{j}") for j in range(kept)]).first()
    flip = np.array([-1.0 if (x or 0.0) < 0 else 1.0 for x in ends])
    rows = scores.select("sample", F.posexplode(F.array(*[F.col("v")[j] * float(flip[j]) for j in range(kept)])).alias("j", "score"))
    shares = [(j + 1, float(x / whole) if whole else 0.0) for j, x in enumerate(d[:kept] ** 2)]
    return rows.select("sample", (F.col("j") + 1).alias("component"), "score"), cells.sparkSession.createDataFrame(shares, "component int, explained double")


def pca_scores(m: DataFrame, k: int = 2, explained: int = 20) -> tuple[DataFrame, DataFrame]:
    """(scores of ``k`` components, explained shares of the first ``explained``) of samples over features, for any number of samples."""
    scores, shares = leading_components(m, max(k, explained))
    return scores.where(F.col("component") <= k), shares


def _sample_products(m: DataFrame, names: list) -> tuple[DataFrame, DataFrame]:
    """All components of a bounded number of samples, from their inner products (one equi join on features)."""
    left, right = m.select("feature", F.col("sample").alias("a"), F.col("value").alias("x")), m.select("feature", F.col("sample").alias("b"), F.col("value").alias("y"))
    dots = left.join(right, "feature").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    return _decompose(m.sparkSession, {(r["a"], r["b"]): r["g"] for r in dots.collect()}, names, len(names))


def remove_batch_components(m: DataFrame, sheet: DataFrame, p_limit: float = 0.05) -> DataFrame:
    """Rebuild the matrix without the components whose sample scores differ between batches (rank test, p under ``p_limit``).

    Only the samples-squared inner products are decomposed on the driver. What a component adds to a feature
    is its loading, one sum over the feature's cells, times the sample's score; both are narrow aggregates.
    Samples outside the sheet stay in the matrix and are not tested. Without such components cells stay as they are.
    """
    names = _names(m)
    scores, explained = _sample_products(m, names)
    real = explained.where("explained > 1e-9").select("component")
    tested = scores.join(sheet.select("sample", "batch").distinct(), "sample").join(F.broadcast(real), "component")
    bad = [r[0] for r in kruskal_wallis(tested, ["component"], "score", "batch").where(F.col("pvalue") < p_limit).select("component").orderBy("component").collect()]
    full = complete(m)
    if not bad:
        return full.select("feature", "sample", F.col("value").cast("double").alias("value"))
    lengths = scores.groupBy("component").agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("_l"))
    unit = scores.where(F.col("component").isin(bad)).join(lengths, "component").select("sample", F.struct("component", (F.col("score") / F.col("_l")).alias("u")).alias("s"))
    axes = settle(unit.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["u"]).alias("_u")))
    loadings = m.join(axes, "sample").groupBy("feature").agg(F.array(*[F.sum(F.col("value") * F.col("_u")[k]) for k in range(len(bad))]).alias("_f"))
    part = F.aggregate(F.zip_with("_f", "_u", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return full.join(axes, "sample").join(loadings, "feature").select("feature", "sample", (F.col("value") - part).alias("value"))


def pca_elbow(explained: DataFrame) -> DataFrame:
    """Components up to where the line from the first to the last share is highest above the shares."""
    s = explained.agg(F.max_by("explained", -F.col("component")).alias("hi"), F.max_by("explained", "component").alias("lo"), F.count(F.lit(1)).alias("n"))
    line = F.col("hi") + (F.col("lo") - F.col("hi")) * (F.col("component") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return explained.join(F.broadcast(s), F.lit(True)).withColumn("g", F.round(line - F.col("explained"), 9)).agg(F.max_by("component", F.struct("g", -F.col("component"))).alias("keep"))


def pcoa(distances: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Principal coordinates (scores, explained shares) of (a, b, distance), each pair once, of any number of samples.

    The doubly centred matrix of squares is decomposed by the same iteration as a matrix of samples by samples; its own
    sign tells axes of negative variance, which get no coordinates. Shares are of the sum of the positive variances found.
    """
    both = distances.where("a <> b").select("a", "b", (-0.5 * F.col("distance") ** 2).alias("v"))
    both = settle(both.union(both.select("b", "a", "v")), "squares")
    n = both.select("a").distinct().count()
    rows = settle(both.groupBy("a").agg((F.sum("v") / n).alias("r")), "rows")
    level = rows.agg(F.avg("r")).first()[0] or 0.0
    centred = both.union(rows.select("a", F.col("a").alias("b"), F.lit(0.0))).join(rows, "a").join(rows.select(F.col("a").alias("b"), F.col("r").alias("c")), "b")
    centred = settle(centred.select(F.col("a").alias("sample"), F.col("b").alias("feature"), (F.col("v") - F.col("r") - F.col("c") + level).alias("value")), "centred")
    # Components of the symmetric matrix have its eigenvalues' sizes as deviations: score = vector times |eigenvalue|.
    scores, _ = leading_components(centred, min(max(k, 20), max(n, 1)))
    scores = settle(scores.withColumn("component", F.col("component")), "found")
    sizes = scores.groupBy("component").agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("size"))
    image = centred.join(scores.select(F.col("sample").alias("feature"), "component", F.col("score").alias("x")), "feature").groupBy("sample", "component").agg(F.sum(F.col("value") * F.col("x")).alias("y"))
    signs = image.join(scores, ["sample", "component"]).groupBy("component").agg(F.sum(F.col("y") * F.col("score")).alias("sign"))
    real = settle(sizes.join(signs, "component").where("sign > 0 and size > 0").withColumn("order", F.row_number().over(Window.orderBy(F.desc("size")))), "axes")
    total = real.agg(F.sum("size")).first()[0] or 1.0
    found = scores.join(F.broadcast(real), "component").where(F.col("order") <= k).select("sample", F.col("order").alias("component"), (F.col("score") / F.sqrt("size")).alias("score"))
    return found, real.select(F.col("order").alias("component"), (F.col("size") / total).alias("explained"))


def knn_graph(scores: DataFrame, k: int = 10) -> DataFrame:
    """(a, b) undirected edges from each sample to its ``k`` nearest by (sample, component, score); the search is exact."""
    parts = [r[0] for r in scores.select("component").distinct().orderBy("component").collect()]
    rows = scores.groupBy("sample").pivot("component", parts).agg(F.first("score")).fillna(0.0)
    names = [f"c{i}" for i in range(len(parts))]
    near = nearest(rows.toDF("sample", *names), "sample", names, k).select("sample", F.explode("near.key").alias("other"))
    return near.select(F.least("sample", "other").alias("a"), F.greatest("sample", "other").alias("b")).distinct()


def graph_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation: the commonest label of a node and its neighbours, ties to the smallest."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "community").union(labels.select("node", "community"))
        counts = votes.groupBy("node", "community").count()
        labels = settle(counts.groupBy("node").agg(F.max_by("community", F.struct("count", -F.col("community"))).alias("community")))
    return labels
