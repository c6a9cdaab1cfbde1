"""Near-duplicate classes from candidates: links through shared keys, and exact verification within groups.

Candidates only say which texts may be alike; every pair of a group of candidates is then decided by a sketch
and by whole shingle sets. Large groups are cut into blocks whose pairs are tasks of their own, and a task
emits the edges of a spanning forest, so neither a bucket nor a group is gathered or written out as pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, slices, table

#: Texts whose shingle sets a task compares with each other; a task holds two such blocks at most.
GROUP = 1024
#: Bits of the filter in front of a join of texts: for each id, at least, at most, and in one of Spark's bitmaps (4 KB).
BITS_AN_ID, LEAST_BITS, MOST_BITS, ROW_BITS = 16, 1 << 23, 1 << 28, 1 << 15


def runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by ``by``, in frames that hold whole runs of equal keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        keys = batch[by].to_numpy()
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if held and (cut or (held[-1][by].to_numpy()[-1] != keys[-1]).any()):
            yield pd.concat([*held, batch[:cut]])
            held = []
        elif cut:
            yield batch[:cut]
        held.append(batch[cut:])
    if held:
        yield pd.concat(held)


def spans(rows: pd.DataFrame, by: list[str]) -> list[tuple[int, int]]:
    """Start and end of each run of two rows or more."""
    keys = rows[by].to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)])).tolist()
    return [(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1]


def tree(n: int, links: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list, list]:
    """Edges of a spanning forest of ``links(x, others)`` among ``n`` things, breadth first."""
    left, right = [], []
    rest = np.arange(n)
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            found = links(x, rest)
            if found.any():
                met = rest[found].tolist()
                left += [x] * len(met)
                right += met
                front += met
                rest = rest[~found]
    return left, right


def chained(rows: DataFrame, tag: str) -> DataFrame:
    """(a, b): edges that connect all ``node`` of one ``key`` (both long), each to the first of its range.

    Rows are cut by ranges of (key, node), so a hot key is many tasks; the first nodes of a key's ranges, one
    a task, are linked to each other. Keys of one group mostly share their first node, so their edges are equal.
    """
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            if b.empty:
                continue
            key, node = b["key"].to_numpy(np.int64), b["node"].to_numpy(np.int64)
            if last is not None:
                key, node = np.concatenate((last[0], key)), np.concatenate((last[1], node))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            root = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            # The first key of a task may go on from the task before, its last key into the next: their roots are told as loops.
            tell = node != root
            tell[0] |= last is None
            yield pd.DataFrame({"key": key[tell], "a": root[tell], "b": node[tell]})
            last = key[-1:], root[-1:]
        if last is not None:
            yield pd.DataFrame({"key": last[0], "a": last[1], "b": last[1]})

    by = ["key", "node"]
    made = rows.select(*by).repartitionByRange(shuffle_parts(rows.sparkSession), *by).sortWithinPartitions(*by).mapInPandas(link, "key long, a long, b long")
    made = table(made, tag)
    loops = made.where("a = b").select("key", "a")
    ends = loops.join(loops.groupBy("key").agg(F.min("a").alias("root")), "key").where("a <> root").select(F.col("root").alias("a"), F.col("a").alias("b"))
    return made.where("a <> b").select("a", "b").union(ends).distinct()


def verified(node: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], near: Callable, like: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs whose sketches are near and whose Jaccard similarity is ``like`` or more."""
    size = np.array([len(x) for x in sets])

    def links(x: int, rest: np.ndarray) -> np.ndarray:
        found = np.minimum(size[rest], size[x]) >= like * np.maximum(size[rest], size[x])
        found[found] = near(sketch[rest[found]], sketch[x])
        for k in np.flatnonzero(found).tolist():
            both = len(np.intersect1d(sets[x], sets[rest[k]], assume_unique=True))
            union = size[x] + size[rest[k]] - both
            found[k] = not union or both / union >= like
        return found

    left, right = tree(len(node), links)
    return node[left], node[right]


def text_id(distinct: np.ndarray) -> bytes:
    """A digest of a text's distinct shingles: equal sets are one text."""
    return xxhash.xxh3_128_digest(distinct.tobytes())


def numbered(texts: DataFrame, tag: str) -> DataFrame:
    """The rows, written once, with a number of their own as ``node``: one doc_id may have several texts, so it names none."""
    return table(texts.withColumn("node", F.monotonically_increasing_id()), tag)


def least_ids(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, least): the smallest doc_id of the component in ``parts`` (node, component) of each linked text (node, doc_id)."""
    linked = table(texts.select("node", "doc_id").join(parts, "node"), "similar-parts")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    return linked.join(least, "component").select("node", "least")


def perhaps_among(rows: DataFrame, column: str, ids: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose ``column`` is one of ``ids`` (one column), and some others: a filter for an exact join that follows.

    Ids set bits at their hashes, in bitmaps that are broadcast, so other rows are not shuffled. At most about one other row
    in 16 passes; with more ids than a sixteenth of ``most_bits`` (32 MB of bitmaps) ever more do, at last all.
    """
    bits = min(most_bits, max(LEAST_BITS, 1 << (BITS_AN_ID * max(1, ids.count()) - 1).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    name = ids.columns[0]
    marked = ids.select(F.shiftright(bit(name), 15).alias("_row"), (bit(name) % ROW_BITS).alias("_bit")).distinct()
    # Dealt out before they are set: else each task of the ids would make bitmaps of a few bits.
    maps = marked.repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    at = bit(column) % ROW_BITS
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), (F.col("_row") == F.shiftright(bit(column), 15)) & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")


def true_links(docs: DataFrame, groups: DataFrame, names: DataFrame, set_of: Callable, sketch_of: Callable, near: Callable, like: float, block: int = GROUP) -> DataFrame:
    """(a, b): edges that connect just the pairs of ``like`` or more within each group of ``groups`` (node, component).

    ``names`` has a row of each text (node, doc_id, text_id), read from the ``docs`` of that doc_id with that set of
    shingles. ``set_of(text)`` are a text's distinct shingle hashes, ``sketch_of(set)`` 64-bit words, and ``near(sketches, one)``
    tells which sketches may belong to pairs of ``like``. Only texts of groups (and few others) are shuffled and hashed again.
    """
    spark = docs.sparkSession
    by = ["component", "i", "j"]
    large = groups.groupBy("component").count().where(F.col("count") > block).select("component", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = groups.join(large, "component", "left").join(names.select("node", "doc_id", "text_id"), "node")
    placed = table(placed.select("node", F.col("doc_id").alias("_of"), "text_id", "component", F.coalesce("blocks", F.lit(1)).alias("blocks")), "similar-placed")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            sets = [set_of(t) for t in b["text"]]
            own = [k for k, (s, x) in enumerate(zip(sets, b["text_id"], strict=True)) if text_id(s) == bytes(x)]
            if own:
                sets = [sets[k] for k in own]
                yield b.iloc[own][["node", "component", "blocks"]].assign(sketch=[sketch_of(s).tobytes() for s in sets], shingles=[s.tobytes() for s in sets])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, by):
            node = rows["node"].to_numpy(np.int64)
            a, b = [node[:0]], [node[:0]]
            for x, y in spans(rows, by):
                sketch = np.frombuffer(b"".join(rows["sketch"].iloc[x:y]), dtype="<u8").reshape(y - x, -1)
                left, right = verified(node[x:y], sketch, [np.frombuffer(s, dtype="<u8") for s in rows["shingles"].iloc[x:y]], near, like)
                a.append(left)
                b.append(right)
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = perhaps_among(texts, "doc_id", placed.select("_of"))
    rows = texts.join(placed.hint("merge"), F.col("doc_id") == F.col("_of")).select("node", "text_id", "component", "blocks", "text")
    rows = rows.mapInPandas(shingled, "node long, component long, blocks int, sketch binary, shingles binary")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "sketch", "shingles")
    rows = rows.repartition(shuffle_parts(spark), *by).sortWithinPartitions(*by)
    return rows.mapInPandas(solve, "a long, b long").where("a <> b").distinct()
