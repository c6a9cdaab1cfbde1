"""SimHash near-duplicates by multi-index hashing.

Fingerprints (64 bits, over word shingles) are linked at ``RADIUS`` = 3 or fewer differing bits. Each
fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most 3 bits, one
segment differs in at most 1, so the Hamming ball of radius 1 around each segment finds every partner:
a fingerprint is stored under its own segment value and asks the values one bit away. As links have no
direction, it is enough that the partner with the extra 1 bit asks, so only set bits are cleared. All
64 bits are then compared.

Scale. Equal texts meet in one row per distinct fingerprint before any search. The rows of a bucket are
never paired in the shuffle: each task walks its bucket breadth first and emits the edges of a spanning
forest, fewer than the bucket has members. Buckets that may hold over ``BLOCK`` fingerprints are cut into
blocks, and each pair of blocks is a task of its own, so no task gathers an unbounded bucket and no pair
is lost. Components are found by joins (``common.components``); nothing is gathered on the driver.

``similar_classes`` is the same search for texts whose five-word shingles have a Jaccard similarity of 0.8
or more. The bits of such fingerprints (here over distinct shingles) differ with a probability of 0.152, so
64 bits are too few for a search by segments. ``Plan`` sizes the fingerprint by the number of texts: a
segment has two bits more than the texts need to be numbered, so that few unlike texts meet in it at any
size, and there are as many segments as leave one pair in ``MISS`` without a segment that differs in at
most one bit. Pairs that meet there and are near in their first 128 bits are joined to groups (a task tells each
of its groups as a star around the smallest node, so edges grow with the nodes, never with the pairs); within a
group every pair is verified by the distance of the complete fingerprints and then by whole shingle sets.
Work grows as the texts times the segments, about n^1.25.

Nulls and odd rows: a null text counts as empty; an empty text has fingerprint zero and is linked like
any other. Null doc_ids keep their row; a component of null ids alone is null. Repeated rows stay.
Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, shuffle_parts, slices, table
from .similar import GROUP, least_ids, numbered, runs, spans, text_id, tree, true_links

RADIUS = 3
SEED = 42
LIKE = 0.8
#: How often a bit differs at ``LIKE``, with room for short texts, and the pairs that no segment may find.
DIFFER, MISS = 0.16, 0.001
#: Bits of the first 128 in which likely near copies may differ: 19 on average at ``LIKE``, over 38 once in 100000 pairs.
LOOSE = 38
#: Share of all bits in which texts whose shingle sets are compared may differ.
FAR = 0.25
#: Segment values that a task compares with each other.
VALUES = 1 << 17
#: Fingerprints that a task compares with each other; a task holds two such blocks at most.
BLOCK = 8192
_SEGMENT = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_ODD = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included: ``width`` words (or all, if fewer) with single spaces between."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(line[i:j], SEED) for i, j in zip(starts[:n].tolist(), (ends[last : last + n] - 1).tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint: bit i is 1 if set in over half of the hashes; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long): the fingerprint of each row's whole text, as a signed 64-bit number."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, width) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long")


def _own_keys() -> list:
    """The two buckets in which a fingerprint is stored: bit 32 names the segment."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    return [low, F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))]


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, fp): each fingerprint under its own segment values and those with one set bit cleared."""
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64).view(np.uint64)
            for tag, seg in ((0, fp & _LOW), (1, fp >> _SEGMENT)):
                row, bit = np.nonzero(seg[:, None] & bits[None, :])
                keys = np.concatenate((seg, seg[row] ^ bits[bit])) | np.uint64(tag << 32)
                yield pd.DataFrame({"bucket": keys.view(np.int64), "fp": np.concatenate((fp, fp[row])).view(np.int64)})

    return nodes.select("fp").mapInPandas(run, "bucket long, fp long")


def _large_buckets(nodes: DataFrame, block: int) -> DataFrame:
    """(bucket, blocks) of the buckets that may hold over two blocks.

    A bucket is filled from its own value and at most 32 others; values with under block / 33
    fingerprints add a block at most in all, so only heavier values are followed.
    """
    heavy = nodes.select(F.explode(F.array(*_own_keys())).alias("key")).groupBy("key").count().where(F.col("count") > block // 33)
    near = F.concat(
        F.array("key"),
        F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit("key", i) == 1), lambda i: F.col("key") - F.expr("1L") * F.pow(F.lit(2.0), i).cast("long")),
    )
    filled = heavy.select(F.explode(near).alias("bucket"), "count").groupBy("bucket").agg(F.sum("count").alias("n"))
    return filled.where(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))


def _forest(fps: np.ndarray) -> tuple[list, list]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, right = [], []
    rest = fps
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            x, front = front[0], front[1:]
            near = np.bitwise_count(rest ^ x) <= RADIUS
            if near.any():
                found = rest[near]
                left += [x] * len(found)
                right += found.tolist()
                rest, front = rest[~near], np.concatenate((front, found))
    return left, right


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning-forest edges of each bucket; rows come sorted by bucket and pair of blocks."""
    for rows in runs(batches, ["bucket", "i", "j"]):
        keys = np.ascontiguousarray(rows[["bucket", "i", "j"]].to_numpy())
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
        # Two askers without an owner of the value meet elsewhere, if they are near at all.
        key = np.ascontiguousarray(keys[:, 0]).view(np.uint64)
        owner = np.where(key >> _SEGMENT, fp >> _SEGMENT, fp & _LOW) == key & _LOW
        owned = np.logical_or.reduceat(owner, starts)
        starts, ends = starts[owned], ends[owned]
        a, b = [], []
        pairs = starts[ends - starts == 2]
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= RADIUS
        a.append(fp[pairs[near]])
        b.append(fp[pairs[near] + 1])
        for s, e in zip(*(x[ends - starts > 2] for x in (starts, ends)), strict=True):
            left, right = _forest(np.unique(fp[s:e]))
            a.append(np.array(left, dtype=np.uint64))
            b.append(np.array(right, dtype=np.uint64))
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        yield pd.DataFrame({"a": a, "b": b})[a != b]


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect just the fingerprints of ``nodes`` (distinct ``fp``) linked directly or through others."""
    spark = nodes.sparkSession
    rows = _buckets(nodes)
    large = _large_buckets(nodes, block)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("bucket", "fp", "own", other).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    rows = rows.repartition(shuffle_parts(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.mapInPandas(_links, "a long, b long")


def classes(docs: DataFrame, width: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the smallest doc_id that links reach."""
    own = table(fingerprints(docs, width), "simhash-own")
    nodes = table(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    groups = components(table(links(nodes, block), "simhash-links"), "simhash-parts")
    linked = nodes.join(groups, nodes["fp"] == groups["node"]).select("fp", "rep", "component")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = linked.join(least, "component").select("fp", "least")
    named = table(nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "simhash-named")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


@dataclass(frozen=True)
class Plan:
    """The segments of a long fingerprint: ``n`` of ``bits`` bits each."""

    bits: int
    n: int

    @classmethod
    def of(cls, texts: int) -> Plan:
        """For a number of texts: wide enough that few meet by chance, and enough segments to miss ``MISS`` of the pairs."""
        bits = max(16, max(texts, 1).bit_length() + 2)
        met = (1 - DIFFER) ** bits * (1 + bits * DIFFER / (1 - DIFFER))
        return cls(bits, max(1, math.ceil(math.log(MISS) / math.log(1 - met)), -(-128 // bits)))

    @property
    def words(self) -> int:
        return -(-self.bits * self.n // 64)


def long_fingerprint(distinct: np.ndarray, words: int) -> np.ndarray:
    """``words`` times 64 bits: bit i is 1 if set in over half of the distinct shingles' hashes (each mixed once a word)."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(distinct), 4080):
        h = distinct[at : at + 4080, None] * _ODD[None, :words]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit into a byte
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(distinct), bitorder="little").view("<u8")


def signatures(docs: DataFrame, plan: Plan, width: int = 5) -> DataFrame:
    """(doc_id, text_id binary, fp binary): digest of the distinct shingles and their long fingerprint, of each row's whole text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, width)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_id": [text_id(x) for x in sets], "fp": [long_fingerprint(x, plan.words).tobytes() for x in sets]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, text_id binary, fp binary")


#: Rows of one value that are compared pair by pair; more are walked breadth first.
_FEW = 8


def _expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start .. start + count - 1 of each row, one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _met_before(word: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, segment: int) -> np.ndarray:
    """Which pairs of rows differ in at most one bit of an earlier segment, as far as ``word`` (128 bits) holds them."""
    apart = word[a] ^ word[b]
    mask = np.uint64((1 << bits) - 1)
    found = np.zeros(len(a), dtype=bool)
    for k in range(min(segment, 128 // bits)):
        at = k * bits
        part = apart[:, at // 64] >> np.uint64(at % 64)
        if at % 64 + bits > 64:
            part = part | apart[:, 1] << np.uint64(64 - at % 64)
        found |= np.bitwise_count(part & mask) <= 1
    return found


def _meet(value: np.ndarray, asks: np.ndarray, word: np.ndarray, node: np.ndarray, low: int, bits: int = 0, segment: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the rows near in ``word`` (two per row) whose segment values differ in at most one bit.

    Pairs that have met in an earlier ``segment`` are connected by that one's edges and left out here, so a group
    of copies is not told once for each segment.

    Rows with ``asks`` hold a value of another block with one bit cleared: they meet that value's owners
    alone. Owners meet rows of their own value and of those with one of the ``low`` lowest bits cleared.
    """
    order = np.lexsort((node, value, asks))
    value, word, node = value[order], word[order], node[order]
    own = int((~asks).sum())
    values, start, count = np.unique(value[:own], return_index=True, return_counts=True)
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    labels: dict[int, np.ndarray] = {}

    def near(rows: np.ndarray, x: int) -> np.ndarray:
        return np.bitwise_count(word[rows] ^ word[x]).sum(axis=1) <= LOOSE

    def pairs(x: np.ndarray, at: np.ndarray, same: bool = False) -> None:
        """Rows ``x`` against all rows (``same``: the later ones) of the values at ``at``."""
        for k in range(0, len(x), 1 << 15):
            rows, to = x[k : k + (1 << 15)], at[k : k + (1 << 15)]
            left, right = np.repeat(rows, count[to]), _expand(start[to], count[to])
            found = np.bitwise_count(word[left] ^ word[right]).sum(axis=1) <= LOOSE
            found &= (right > left) | ~np.bool_(same)
            a.append(left[found])
            b.append(right[found])

    def grown(members: np.ndarray) -> np.ndarray:
        """Tells a forest of ``members``, whose trees start at the smallest node, and labels them by tree."""
        left, right = tree(len(members), lambda i, rest: near(members[rest], members[i]))
        a.append(members[left])
        b.append(members[right])
        label = np.arange(len(members))
        for x, y in zip(left, right, strict=True):
            label[y] = label[x]
        return label

    def trees(v: int) -> tuple[np.ndarray, np.ndarray]:
        members = np.arange(start[v], start[v] + count[v])
        if v not in labels:
            labels[v] = grown(members)
        return members, labels[v]

    def joined(v: int, w: int) -> None:
        """One edge for each two trees of two values that hold a near pair, so a hot value is not told for each of its neighbours."""
        (x, of), (y, to) = sorted((trees(v), trees(w)), key=lambda t: len(t[0]))
        for k in np.unique(of).tolist():
            rest, open_ = y, to
            for i in x[of == k].tolist():
                hit, first = np.unique(np.where(near(rest, i), open_, -1), return_index=True)
                hit, first = hit[hit >= 0], first[hit >= 0]
                a.append(np.full(len(hit), i))
                b.append(rest[first])
                left = ~np.isin(open_, hit)
                rest, open_ = rest[left], open_[left]
                if not len(rest):
                    break

    def place(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values``, and which are there."""
        to = np.searchsorted(values, wanted)
        return to, (values[np.minimum(to, len(values) - 1)] == wanted) & (to < len(values)) if len(values) else np.zeros(len(wanted), dtype=bool)

    at = np.repeat(np.arange(len(values)), count)
    few = count <= _FEW
    alone = np.flatnonzero(few[at])
    pairs(alone, at[alone], same=True)
    for v in np.flatnonzero(~few).tolist():
        trees(v)
    for k in range(low):
        asking = np.flatnonzero(values & (1 << k))
        to, hit = place(values[asking] ^ (1 << k))
        asking, to = asking[hit], to[hit]
        both = few[asking] & few[to]
        rows = _expand(start[asking[both]], count[asking[both]])
        pairs(rows, np.repeat(to[both], count[asking[both]]))
        for v, w in zip(asking[~both].tolist(), to[~both].tolist(), strict=True):
            joined(v, w)
    x = np.arange(own, len(value))
    to, hit = place(value[x])
    x, to = x[hit], to[hit]
    both = few[to] & (np.bincount(to, minlength=len(values))[to] <= _FEW)
    pairs(x[both], to[both])
    for v in np.unique(to[~both]).tolist():
        members = np.union1d(x[to == v], np.arange(start[v], start[v] + count[v]))
        grown(members[np.argsort(node[members], kind="stable")])
    a, b = np.concatenate(a), np.concatenate(b)
    if segment:
        new = ~_met_before(word, a, b, bits, segment)
        a, b = a[new], b[new]
    return node[a], node[b]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as those of the edges (a, b), each as a star around its smallest node: fewer edges than nodes."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root != root[root]).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    far = root != np.arange(len(nodes))
    return nodes[root[far]], nodes[far]


def _wide_links(nodes: DataFrame, plan: Plan, block: int) -> DataFrame:
    """(a, b): edges that connect the ``rep`` of all ``nodes`` (rep, fp) near each other in a segment and in their first 128 bits.

    A task takes the values of one segment with the same top bits, about ``block`` of them; a value asks in
    the tasks whose top bits are its own with one set bit cleared. Tasks with far more values (a large group
    of copies) are cut into blocks whose pairs are tasks.
    """
    spark = nodes.sparkSession
    by = ["task", "i", "j"]
    top = min(plan.bits, max(0, (nodes.count() // block).bit_length()))
    low = plan.bits - top

    def values(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(places, tasks, values, asks) of a slice of nodes, segment by segment."""
        raw = np.frombuffer(b"".join(b["fp"]), dtype=np.uint8).reshape(len(b), -1)
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        scale = 1 << np.arange(plan.bits, dtype=np.int64)
        for k in range(plan.n):
            value = bits[:, k * plan.bits : (k + 1) * plan.bits].astype(np.int64) @ scale
            for flip in (0, *(1 << np.arange(low, plan.bits, dtype=np.int64)).tolist()):
                rows = np.flatnonzero(value & flip == flip)
                v = value[rows] ^ flip
                yield rows, (k << top) + (v >> low), v, bool(flip)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(plan.n << top, dtype=np.int64)
        for b in slices(batches, 8192):
            for _, task, _, _ in values(b):
                n += np.bincount(task, minlength=len(n))
        yield pd.DataFrame({"task": np.flatnonzero(n), "n": n[n > 0]})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 8192):
            rep = b["rep"].to_numpy(np.int64)
            word = np.array([np.frombuffer(x, dtype="<i8", count=2) for x in b["fp"]], dtype=np.int64).reshape(-1, 2)
            for rows, task, v, asks in values(b):
                yield pd.DataFrame({"task": task, "value": v, "asks": asks, "w0": word[rows, 0], "w1": word[rows, 1], "rep": rep[rows]})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, by):
            for x, y in spans(rows, by):
                r = rows.iloc[x:y]
                word = np.ascontiguousarray(r[["w0", "w1"]].to_numpy(np.int64)).view(np.uint64)
                a, b = _meet(r["value"].to_numpy(np.int64), r["asks"].to_numpy(bool), word, r["rep"].to_numpy(np.int64), low, plan.bits, int(r["task"].iloc[0]) >> top)
                a, b = _stars(a, b)
                yield pd.DataFrame({"a": a, "b": b})

    sizes = nodes.select("fp").mapInPandas(tally, "task long, n long").groupBy("task").agg(F.sum("n").alias("n"))
    large = table(sizes.where(F.col("n") > 4 * block).select("task", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-large")
    rows = nodes.select("rep", "fp").mapInPandas(spread, "task long, value long, asks boolean, w0 long, w1 long, rep long")
    rows = rows.join(large, "task", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("task", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "value", "asks", "w0", "w1", "rep")
    rows = rows.repartition(shuffle_parts(spark), *by).sortWithinPartitions(*by)
    return rows.mapInPandas(solve, "a long, b long").where("a <> b").distinct()


def similar_classes(docs: DataFrame, width: int = 5, like: float = LIKE, block: int = VALUES, group: int = GROUP) -> DataFrame:
    """(doc_id, component_id): classes of near copies, verified to be ``like`` or more alike.

    Rows of one shingle set are one node. Nodes that the search joins are a
    group, in which complete fingerprints and whole shingle sets decide every pair. Rows without a doc_id
    are in no class.
    """
    plan = Plan.of(docs.count())
    own = table(signatures(docs, plan, width), "simhash-signatures")
    texts = own.where("doc_id is not null").groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"))
    nodes = numbered(texts, "simhash-nodes").withColumn("rep", F.col("node"))
    groups = components(table(_wide_links(nodes, plan, block), "simhash-wide"), "simhash-groups")
    most = FAR * 64 * plan.words
    near = lambda fps, x: np.bitwise_count(fps ^ x).sum(axis=1, dtype=np.int64) <= most
    found = true_links(docs, groups, nodes, lambda t: np.unique(shingle_hashes(t, width)), lambda s: long_fingerprint(s, plan.words), near, like, group)
    true = table(found, "simhash-true")
    named = nodes.join(least_ids(nodes, components(true, "simhash-parts")), "node", "left").select("text_id", F.coalesce("least", "doc_id").alias("component_id"))
    return own.join(named, "text_id", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class, the document of its smallest doc_id.

    A doc_id stands for one document: if its rows hold several texts, one row of each text stays. Rows
    whose doc_id is null are kept.
    """
    found = table(similar_classes(docs, width), "simhash-classes")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("last"), F.count(F.lit(1)).alias("n"))
    gone = ids.where("last < doc_id").select(F.col("doc_id").alias("_gone"))
    kept = docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")
    repeated = ids.where("n > 1").select(F.col("doc_id").alias("_again"))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept["doc_id"] == repeated["_again"], "left_anti")
    again = kept.join(repeated, kept["doc_id"] == repeated["_again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)
