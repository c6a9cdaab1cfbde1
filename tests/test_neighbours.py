"""Neighbour searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandtable.operators import exploration, neighbours


def plain_nearest(x, i, k):
    far = np.round(((x - x[i]) ** 2).sum(axis=1), neighbours.DIGITS)
    far[i] = -1
    return [int(j) for j in np.lexsort((np.arange(len(x)), far))[1 : k + 1]]


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"c{j} double" for j in range(x.shape[1])))


@pytest.mark.parametrize("d", [1, 2, 6])
def test_nearest_is_exact(spark, d):
    """20,000 rows, a third of them on few values, some far away: every neighbour of every asking row is found."""
    rng = np.random.default_rng(d)
    x = rng.normal(size=(20_000, d))
    x[:7000] = np.round(x[:7000])
    x[-500:] *= 40
    got = {r.id: [n.key for n in r.near] for r in neighbours.nearest(frame(spark, x), "id", [f"c{j}" for j in range(d)], 9, F.col("id") % 40 == 0).collect()}
    x = np.round(x, neighbours.DIGITS)
    assert len(got) == 500 and all(got[i] == plain_nearest(x, i, 9) for i in got)


def test_nearest_in_small_blocks_and_odd_tables(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(300, 3)), np.zeros((150, 3))])
    df = frame(spark, x).union(spark.createDataFrame([(900, None, 1.0, 2.0)], "id long, c0 double, c1 double, c2 double"))
    got = {r.id: [n.key for n in r.near] for r in neighbours.nearest(df, "id", ["c0", "c1", "c2"], 5, block=8).collect()}
    x = np.round(x, neighbours.DIGITS)
    assert got == {i: plain_nearest(x, i, 5) for i in range(450)}
    assert {len(r.near) for r in neighbours.nearest(df.limit(3), "id", ["c0"], 5).collect()} == {2}
    assert neighbours.nearest(df.limit(0), "id", ["c0"], 5).collect() == []


def plain_impute(x, targets, k=10, use=3):
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    values, axes = np.linalg.eigh(np.cov(z.T).reshape(x.shape[1], x.shape[1]))
    values, axes = values[::-1], axes[:, ::-1]
    p = np.round(z @ axes[:, : neighbours.elbow(values)], neighbours.DIGITS)
    out = targets.copy()
    for i, j in zip(*np.where(np.isnan(targets)), strict=True):
        near = [targets[n, j] for n in plain_nearest(p, i, k - 1) if not math.isnan(targets[n, j])][:use]
        out[i, j] = np.median(near) if near else np.nanmedian(targets[:, j])
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_imputed_cells_by_brute_force(spark, d):
    """Cells of two targets, some of whose neighbours miss the value too."""
    rng = np.random.default_rng(20 + d)
    n = 1500
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    x[: n // 3] = np.round(x[: n // 3])
    t = np.column_stack([x[:, 0] + rng.normal(size=n) / 9, rng.integers(0, 50, n).astype(float)])
    t[rng.random((n, 2)) < 0.1] = np.nan
    t[np.argsort(x[:, 0])[:40], 1] = np.nan
    rows = [(f"{i:05d}", *map(float, x[i]), *(None if math.isnan(v) else float(v) for v in t[i])) for i in range(n)]
    names = [f"c{j}" for j in range(d)]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{c} double" for c in names) + ", t0 double, t1 double")
    got = np.array([(r.t0, r.t1) for r in exploration.knn_impute(df, "id", names, ["t0", "t1"]).orderBy("id").collect()])
    assert np.allclose(got, plain_impute(x, t), rtol=0, atol=1e-12)


def test_impute_without_whole_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1.0, None), (3, 2.0, 4.0)], "id int, a double, t double")
    assert {r.id: r.t for r in exploration.knn_impute(df, "id", ["a"], "t").collect()} == {1: 2.0, 2: 3.0, 3: 4.0}


def test_elbow_is_where_the_line_is_highest():
    assert [neighbours.elbow(np.array(v)) for v in ([], [3.0], [2.0, 1.0], [9.0, 2.0, 1.5, 1.0], [4.0, 3.9, 0.2, 0.1])] == [0, 1, 1, 2, 3]
