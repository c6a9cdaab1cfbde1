"""The similarity join against all pairs."""

import numpy as np
import pytest

from strandtable.operators.vectors import HashPlan, cosine_join


def frame(spark, name, x, first=0):
    return spark.createDataFrame([(first + i, list(map(float, r))) for i, r in enumerate(x)], f"{name} long, embedding array<float>")


def true_pairs(a, b, limit):
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a.astype(np.float32).astype(float), b.astype(np.float32).astype(float)))
    return {(int(i), int(j)) for i, j in zip(*np.where(a @ b.T >= limit), strict=True)}


def at_angle(rng, x, cosine):
    """Vectors of the given cosine to those of ``x``."""
    noise = rng.normal(size=x.shape)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * unit + np.sqrt(1 - cosine**2) * noise


@pytest.mark.parametrize("limit", [0.75, 0.9])
def test_recall_of_pairs_just_above_the_limit(spark, limit):
    rng = np.random.default_rng(int(100 * limit))
    tags = rng.normal(size=(4000, 48))
    queries = np.vstack([at_angle(rng, tags[:1500], limit + 0.002), rng.normal(size=(500, 48))])
    got = {(r.query_id, r.tag_id) for r in cosine_join(frame(spark, "query_id", queries), frame(spark, "tag_id", tags), limit)[0].collect()}
    want = true_pairs(queries, tags, limit)
    assert len(want) >= 1500 and got <= want and len(got) / len(want) >= 0.93


def test_recall_on_the_whole_table_of_embeddings(spark):
    """Random vectors at a low limit, the hardest case: all pairs of the table are the truth."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id")
    x = np.stack([np.array(r.embedding) for r in e.collect()])
    ids = [r.vec_id for r in e.collect()]
    pairs = cosine_join(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "tag_id"), 0.4)[0]
    got = {(r.query_id, r.tag_id) for r in pairs.where("query_id < tag_id").collect()}
    want = {(ids[i], ids[j]) for i, j in true_pairs(x, x, 0.4) if ids[i] < ids[j]}
    assert got <= want and len(want) > 500 and len(got) / len(want) >= 0.9


def test_copies_are_one_and_odd_vectors_match_nothing(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (None, [1.0, 2.0]), (7, [-2.0, 1.0])]
    q, t = (spark.createDataFrame(rows, f"{n} long, embedding array<double>") for n in ("query_id", "tag_id"))
    pairs, of_q, of_t = cosine_join(q, t, 0.9)
    assert sorted((r.query_id, r.tag_id, round(r.similarity, 9)) for r in pairs.collect()) == [(1, 1, 1.0), (7, 7, 1.0)]
    assert {r.query_id: r.rep for r in of_q.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 7} == {r.tag_id: r.rep for r in of_t.collect()}
    assert cosine_join(q.limit(0), t, 0.9)[0].collect() == [] == cosine_join(q, t.limit(0), 0.9)[0].collect()
    with pytest.raises(ValueError):
        cosine_join(q, t, 0.0)


def test_plan_grows_slower_than_the_table():
    """A query's candidates (probes times the rows of a bucket) grow by less than the square root of the rows."""
    seen = [HashPlan.of(n, 0.9, 0.95) for n in (10**4, 10**6, 10**8)]
    met = [p.probes * n / 2**p.bits for p, n in zip(seen, (10**4, 10**6, 10**8), strict=True)]
    assert met[1] < 10 * met[0] and met[2] < 10 * met[1] and met[2] < 10**8 / 1000
