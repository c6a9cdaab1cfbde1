"""Cosine similarity join of two large sets of dense vectors: random hyperplanes, probed where a query lies close to them.

A table cuts space by some hyperplanes into buckets. A tag is in one bucket of each table. A query looks into its own
bucket and into those across one or two of the hyperplanes that it lies closest to. ``HashPlan`` takes as many
hyperplanes as leave about ``BUCKET`` vectors in a bucket, whatever their number, and the cheapest number of probes and tables
that finds a pair at the limit with the wanted probability; pairs above the limit are found more surely. What meets in a
bucket is first compared by ``SKETCH`` signs that travel with the key (a pair at the limit fails that once in 30,000 times), and what
passes is verified by the vectors themselves, so no pair below the limit is returned.

``cosine_matches`` compares a stated query set with all tags, exactly, in products of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import settle

#: Vectors that a bucket should hold, and signs of a sketch.
BUCKET, SKETCH = 32, 256
#: Vectors of one side in a product of blocks, queries multiplied at once, pairs verified at once, and what a product's rounding may amount to.
SIDE, ROWS, PAIRS, SLACK = 4096, 256, 1 << 16, 1e-9


@dataclass(frozen=True)
class HashPlan:
    """``tables`` of ``bits`` hyperplanes; a query crosses up to two of its ``flips`` closest ones."""

    bits: int
    flips: int
    tables: int

    @classmethod
    def of(cls, n: int, limit: float, recall: float) -> HashPlan:
        """The plan of least cost: a probe costs its own row and what its bucket holds, a table costs a row for each tag."""
        bits = min(48, max(2, math.ceil(math.log2(max(n, 2) / BUCKET))))
        slope = limit / math.sqrt(max(1e-12, 1 - limit * limit))
        margins = np.sort(np.abs(np.random.Generator(np.random.PCG64(1)).normal(size=(1000, bits))), axis=1)
        same = 0.5 * (1 + np.vectorize(math.erf)(slope * margins / math.sqrt(2)))
        plans = []
        for flips in range(bits + 1):
            # Chances of no, one and two crossed planes among the closest, if the others are not crossed.
            none, one, two = np.ones(len(same)), np.zeros(len(same)), np.zeros(len(same))
            for k in range(flips):
                stay, cross = same[:, k], 1 - same[:, k]
                none, one, two = none * stay, one * stay + none * cross, two * stay + one * cross
            met = float((np.prod(same[:, flips:], axis=1) * (none + one + two)).mean())
            plans.append(cls(bits, flips, 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))))
        return min(plans, key=lambda p: (2 * p.probes + p.tables, p.flips))

    @property
    def crossings(self) -> list[tuple[int, ...]]:
        """Which of the closest planes each probe crosses."""
        return [c for k in range(3) for c in combinations(range(self.flips), k)]

    @property
    def probes(self) -> int:
        return self.tables * len(self.crossings)


def vector_classes(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, rep): rows of equal vectors share the smallest key among them. Null vectors have none."""
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.sha2(F.col(vector).cast("array<double>").cast("string"), 256).alias("_digest"))
    reps = rows.groupBy("_digest").agg(F.min(key).alias("rep"))
    return rows.join(reps, "_digest").select(key, "rep")


def _units(df: DataFrame, key: str, classes: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(id, v): one unit vector of each class, written once; zero vectors and such of another length than the longest go."""
    reps = classes.where(F.col(key) == F.col("rep")).select(F.col("rep").alias("id")).distinct()
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("id"), v.alias("v")).where(F.col("v").isNotNull()).join(reps, "id", "left_semi").dropDuplicates(["id"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = settle(rows.withColumn("_n", norm).where("_n > 0").select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v")), "units")
    return rows, rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]


def _hashed(units: DataFrame, dim: int, plan: HashPlan, probe: bool, seed: int) -> DataFrame:
    """(id, sketch, key): a row for each table, or with ``probe`` for each of the plan's probes."""
    kind = units.schema["id"].dataType.simpleString()
    many = max(SKETCH, plan.bits * plan.tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.Generator(np.random.PCG64(seed)).normal(size=(dim, many))
        powers = 1 << np.arange(plan.bits, dtype=np.int64)
        crossed = np.zeros((len(plan.crossings) if probe else 1, plan.flips), dtype=np.int64)
        for row, some in zip(crossed, plan.crossings, strict=False):
            row[list(some)] = 1
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                side = np.stack(part["v"].to_numpy()) @ planes
                signs = side > 0
                sketch = np.packbits(signs[:, :SKETCH], axis=1).view(np.int64)
                keys = []
                for t in range(plan.tables):
                    own = slice(t * plan.bits, (t + 1) * plan.bits)
                    base = signs[:, own] @ powers
                    close = powers[np.argsort(np.abs(side[:, own]), axis=1)[:, : plan.flips]]
                    keys.append((base[:, None] ^ (close @ crossed.T)) | (t << 48))
                keys = np.concatenate(keys, axis=1)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "sketch": list(sketch), "keys": list(keys)})

    rows = units.where(F.size("v") == dim).mapInPandas(run, f"id {kind}, sketch array<long>, keys array<long>")
    return rows.select("id", "sketch", F.explode("keys").alias("key"))


def cosine_join(queries: DataFrame, tags: DataFrame, limit: float = 0.75, recall: float = 0.95, seed: int = 1, vector: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of ``queries`` (query_id) and ``tags`` (tag_id) of cosine similarity ``limit`` (above 0) or more.

    Returns (pairs, query classes, tag classes). Pairs are (query_id, tag_id, similarity) of class representatives; classes
    are (id, rep) with the smallest id of the rows of equal vectors, so that copies need not be expanded. A pair at the limit
    is found with probability ``recall``, closer ones more surely. Null and zero vectors match nothing.
    """
    if not 0 < limit <= 1:
        raise ValueError("the limit is above 0 and at most 1")
    of_queries, of_tags = settle(vector_classes(queries, "query_id", vector)), settle(vector_classes(tags, "tag_id", vector))
    (q, dim), (t, wide) = _units(queries, "query_id", of_queries, vector), _units(tags, "tag_id", of_tags, vector)
    dim = max(dim, wide)
    plan = HashPlan.of(t.count(), min(limit, 1 - 1e-9), recall)
    if plan.tables > 1 << 15:
        raise ValueError("so many pairs reach so low a limit that hashing does not help; compare a stated set of queries instead")
    apart = math.acos(limit) / math.pi
    most = math.floor(SKETCH * apart + 4 * math.sqrt(SKETCH * apart * (1 - apart)))
    left = _hashed(q, dim, plan, True, seed).withColumnsRenamed({"id": "query_id", "sketch": "_s"})
    right = _hashed(t, dim, plan, False, seed).withColumnsRenamed({"id": "tag_id", "sketch": "_t"})
    differ = sum((F.bit_count(F.col("_s")[i].bitwiseXOR(F.col("_t")[i])) for i in range(SKETCH // 64)), F.lit(0))
    met = settle(left.join(right, "key").where(differ <= most).select("query_id", "tag_id").distinct(), "met")
    dot = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = met.join(q.withColumnsRenamed({"id": "query_id", "v": "_q"}), "query_id").join(t.withColumnsRenamed({"id": "tag_id", "v": "_v"}), "tag_id")
    pairs = pairs.select("query_id", "tag_id", dot.alias("similarity")).where(F.col("similarity") >= limit)
    return pairs, of_queries, of_tags


def cosine_matches(queries: DataFrame, tags: DataFrame, limit: float | None = None, k: int | None = None, digits: int = 6, vector: str = "embedding") -> DataFrame:
    """(query_id, tag_id, similarity) of a stated query set against all tags: pairs of at least ``limit``, or those that may be a query's best ``k``.

    With ``k``, a query's pairs hold its best k by similarity rounded to ``digits`` and then by tag, and some more. Every pair is
    compared, in products of two blocks of about ``SIDE`` vectors, so a task holds two blocks however large the sides are; each side is
    sent once for each block of the other. What passes is computed again in the order of the elements. Null, zero
    and vectors of unlike length match nothing.
    """
    kinds = {c: dict(d.dtypes)[c] for c, d in (("query_id", queries), ("tag_id", tags))}
    many = {c: max(1, math.ceil(d.count() / SIDE)) for c, d in (("query_id", queries), ("tag_id", tags))}

    def side(df: DataFrame, key: str) -> DataFrame:
        norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))
        rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), norm.alias("n")).where("n > 0").withColumn(f"_{key}", F.pmod(F.xxhash64("id"), F.lit(many[key])))
        for other in many.keys() - {key}:
            rows = rows.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.lit(many[other] - 1)).cast("array<long>")))
        return rows.groupBy("_query_id", "_tag_id")

    def pairs_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(s.shape, dtype=bool) if limit is None else ~(s < limit - SLACK)
        if k is not None and s.shape[1] > k:
            last = np.partition(s, -k, axis=1)[:, -k][:, None]
            keep &= np.isnan(s) | (s >= last - 10.0**-digits - SLACK)
        return np.nonzero(keep)

    def first_of_equal(i: np.ndarray, j: np.ndarray, similar: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of pairs of one query and the very same similarity only the first ``k`` tags count."""
        order = np.lexsort((place[j], similar, i))
        a, b = i[order], similar[order]
        new = np.r_[True, (a[1:] != a[:-1]) | ((b[1:] != b[:-1]) & ~(np.isnan(b[1:]) & np.isnan(b[:-1])))]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        return order[np.arange(len(a)) - begin < k]

    def match(q: pa.Table, t: pa.Table) -> pa.Table:
        out = []
        sizes = [pc.list_value_length(x["v"]).to_numpy() for x in (q, t)]
        for size in np.intersect1d(*sizes):
            at = [np.flatnonzero(n == size) for n in sizes]
            (a, an), (b, bn) = (
                (x["v"].take(some).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size), x["n"].take(some).to_numpy()) for x, some in zip((q, t), map(pa.array, at), strict=True)
            )
            place = np.argsort(pc.sort_indices(t["id"].take(pa.array(at[1])), null_placement="at_start").to_numpy()) if k else None
            for low in range(0, len(a), ROWS):
                i, j = pairs_of((a[low : low + ROWS] @ b.T) / (an[low : low + ROWS, None] * bn))
                i += low
                dot = [np.cumsum(a[i[x : x + PAIRS]] * b[j[x : x + PAIRS]], axis=1)[:, -1] for x in range(0, len(i), PAIRS)]
                similar = np.concatenate([*dot, []]) / (an[i] * bn[j])
                if k and len(i):
                    some = first_of_equal(i, j, similar, place)
                    i, j, similar = i[some], j[some], similar[some]
                out.append((at[0][i], at[1][j], similar))
        i, j, similar = (np.concatenate([o[x] for o in out]) if out else np.array([], dtype=kind) for x, kind in enumerate((int, int, float)))
        return pa.table({"query_id": q["id"].take(pa.array(i)), "tag_id": t["id"].take(pa.array(j)), "similarity": similar})

    found = side(queries, "query_id").cogroup(side(tags, "tag_id")).applyInArrow(match, f"query_id {kinds['query_id']}, tag_id {kinds['tag_id']}, similarity double")
    return found if limit is None else found.where(F.col("similarity") >= limit)
