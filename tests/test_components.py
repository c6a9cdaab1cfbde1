"""Ordination of more samples than a driver's matrix could hold, against exact decompositions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandtable.operators import community


def long_form(spark, x):
    i, j = np.nonzero(x)
    return spark.createDataFrame(pd.DataFrame({"sample": i, "feature": j, "value": x[i, j]}))


def wide(scores, n, k):
    t = scores.toPandas().pivot(index="sample", columns="component", values="score").reindex(range(n)).to_numpy()
    assert t.shape == (n, k)
    return t


def exact(x, k):
    c = x - x.mean(axis=0)
    u, d, _ = np.linalg.svd(c, full_matrices=False)
    return (u * d)[:, :k], d**2 / (d**2).sum()


def assert_same_axes(got, want):
    for j in range(want.shape[1]):
        sign = np.sign(got[:, j] @ want[:, j])
        assert np.abs(got[:, j] - sign * want[:, j]).max() <= 1e-6 * np.abs(want[:, j]).max()


def test_components_of_many_samples_are_the_exact_ones(spark):
    """4,500 samples, 60 features: leading scores within a millionth, shares, and signs by the greatest entry."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4500, 6)) * [30, 20, 13, 8, 5, 3] @ rng.normal(size=(6, 60)) + rng.normal(size=(4500, 60))
    x[rng.random(x.shape) < 0.02] = 0
    scores, shares = community.pca_scores(long_form(spark, x), 4, 5)
    want, parts = exact(x, 4)
    got = wide(scores, 4500, 4)
    assert_same_axes(got, want)
    assert [r.explained for r in shares.orderBy("component").collect()] == pytest.approx(list(parts[:5]), rel=1e-9)
    assert all(got[np.argmax(np.abs(got[:, j])), j] > 0 for j in range(4))


@pytest.mark.parametrize("shape", [(9, 200), (200, 4), (3, 2)])
def test_components_where_one_side_is_small(spark, shape):
    rng = np.random.default_rng(shape[0])
    x = rng.normal(size=shape) * np.arange(1, shape[1] + 1)
    k = min(3, shape[0] - 1, shape[1])
    scores, shares = community.pca_scores(long_form(spark, x), k)
    want, parts = exact(x, k)
    assert_same_axes(wide(scores, shape[0], k), want)
    assert [r.explained for r in shares.orderBy("component").limit(k).collect()] == pytest.approx(list(parts[:k]))
    assert community.pca_scores(long_form(spark, x).limit(0), 2)[0].collect() == []


def test_principal_coordinates_give_the_points_back(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 3)) * [9, 4, 2]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    a, b = np.triu_indices(150, 1)
    scores, shares = community.pcoa(spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "distance": far[a, b]})), 3)
    want, parts = exact(x, 3)
    assert_same_axes(wide(scores, 150, 3), want)
    assert [r.explained for r in shares.orderBy("component").limit(3).collect()] == pytest.approx(list(parts), rel=1e-6)


def test_neighbour_graph_of_many_samples(spark):
    """4,200 samples: the edges of brute force; more than the driver's limit before."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(4200, 2)), 6)
    scores = spark.createDataFrame(pd.DataFrame({"sample": np.repeat(np.arange(4200), 2), "component": np.tile([1, 2], 4200), "score": x.ravel()}))
    got = {(r.a, r.b) for r in community.knn_graph(scores, 3).collect()}
    want = set()
    for i in range(4200):
        far = np.round(((x - x[i]) ** 2).sum(axis=1), 9)
        far[i] = np.inf
        want |= {(min(i, j), max(i, j)) for j in np.lexsort((np.arange(4200), far))[:3].tolist()}
    assert got == want


def test_unsettled_components_say_so(spark):
    x = np.random.default_rng(2).normal(size=(400, 300))
    with pytest.raises(RuntimeError):
        community.leading_components(long_form(spark, x), 5, most_rounds=2)
    assert community.leading_components(long_form(spark, x).withColumn("value", F.lit(1.0)), 2)[1].agg(F.max("explained")).first()[0] == 0.0
