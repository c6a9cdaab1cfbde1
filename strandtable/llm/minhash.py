"""Document fingerprints by MinHash.

A text's shingles (five lower-cased words; fewer words make one shingle) are hashed to 64 bits, and 128
universal hash functions ``a * x + b mod 2**64`` (random odd a) are minimised over them in numpy. A
fingerprint holds 16 bits of each minimum; the likeness of two fingerprints is the share of equal places,
an estimate of the Jaccard similarity with a standard error of at most 0.045. Near-duplicates share one of 16
bands of four places, which meet in Spark (a pair at 0.8 is missed with a probability of 0.0002), and are
verified by their exact Jaccard similarity.

Nulls and odd rows: a null text is empty; texts without words have an empty shingle of their own, so they
equal each other. Repeated rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_table, shuffle_parts, slices, table
from .similar import GROUP, chained, least_ids, numbered, text_id, true_links

PLACES = 128
WIDTH = 5
BAND, BANDS = 4, 16
LIKE = 0.8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _functions(places: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    a = draw.integers(0, 2**63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], draw.integers(0, 2**63, places, dtype=np.uint64)[:, None]


_A, _B = _functions(PLACES)


def word_hashes(words: list[str]) -> np.ndarray:
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(w) for w in words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the shingles of a text whose words have the given hashes."""
    width = min(width, len(words))
    if not width:
        return np.zeros(1, dtype=np.uint64)
    n = len(words) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function; all ones for no shingles."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (_A * shingles[at : at + 512] + _B).min(axis=1), out=least)
    return least


def places(least: np.ndarray) -> np.ndarray:
    """16 well-mixed bits of each minimum."""
    return ((least ^ (least >> np.uint64(31))) * _MIX >> np.uint64(48)).astype(">u2")


def fingerprint(text: str | None) -> np.ndarray:
    return places(minima(shingle_hashes(word_hashes((text or "").lower().split()))))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_pair(text: str, after: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text, and the fingerprints of the text and of the edited text.

    The edit replaces the last third of ``text`` by the start of ``after``; shingles before it are
    hashed and minimised once for both.
    """
    cut = len(text) // 3
    kept = text[: len(text) - cut]
    edited = kept + after[:cut]
    words, new = text.lower().split(), edited.lower().split()
    same = 0
    most = min(len(words), len(new), max(0, len(kept.split()) - 1))
    if words[:most] == new[:most]:
        same = most
    h = word_hashes(words)
    both, tail = h, word_hashes(new[same:])
    new_h = np.concatenate((both[:same], tail))
    whole, other = shingle_hashes(h), shingle_hashes(new_h)
    common = max(0, same - WIDTH + 1) if min(len(words), len(new)) >= WIDTH else 0
    shared = minima(whole[:common])
    return edited, places(np.minimum(shared, minima(whole[common:]))), places(np.minimum(shared, minima(other[common:])))


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, n_links long"


def _edited_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per document from rows in order of slice; a slice ends with its ghost, the next slice's first.

    Rows of kind 0 go before the documents of their doc_id and tell the classes of its texts.
    """
    before, key, classes = None, None, {}
    for batch in slices(batches):
        out = []
        for row in batch.itertuples(index=False):
            if row.key != key:
                key, classes = row.key, {}
            if row.kind == 0:
                classes[row.text_id] = (int(row.class_id), int(row.n_links))
                continue
            if before is not None and before[0].part == row.part and not before[0].ghost:
                out.append(_edited_row(*before, row.text))
            before = row, classes
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _EDITED.split(", ")]).astype({"doc_id": "Int64", "class_id": "Int64"})


def _edited_row(row: tuple, classes: dict, after: str) -> tuple:
    edited, own, new = edited_pair(row.text, after)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
    class_id, n_links = classes.get(text_id(shingle_set(row.text)), (doc_id, 0)) if classes else (doc_id, 0)
    return doc_id, len(row.text), digest, own.tobytes().hex(), new.tobytes().hex(), likeness(own, new), likeness(own, fingerprint(after)), class_id, n_links


def with_edited(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose tail comes from the next document.

    Documents follow each other by descending doc_id (null last, equal ids by text), the first after
    the last. The order is cut into slices of even size at quantiles of doc_id, a slice is one partition,
    and each slice gets a copy of the next one's first rows, so texts are shuffled once. ``classes`` as
    ``near_duplicates`` makes them travel along as narrow rows; without them every row is its own class.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    none = [F.lit(None).cast("binary").alias("text_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("n_links")]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    n = shuffle_parts(spark)
    cuts = rows.select(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, key.to_numpy(), side="left"), dtype="int32")

    rows = rows.withColumn("part", part("key"))
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.max("key").alias("first")).collect())
    ghosts = [(firsts[(k + 1) % len(firsts)][1], p) for k, (p, _) in enumerate(firsts)]
    copies = spark.createDataFrame(ghosts, "first long, into int")
    copies = rows.join(F.broadcast(copies), rows["key"] == copies["first"]).select("doc_id", "text", "key", F.col("into").alias("part"), F.lit(1).alias("ghost"), F.lit(1).alias("kind"), *none)
    rows = rows.select("doc_id", "text", "key", "part", F.lit(0).alias("ghost"), F.lit(1).alias("kind"), *none).union(copies)
    if classes is not None:
        told = classes.where("text_id is not null and doc_id is not null and (class_id <> doc_id or n_links > 0)")
        told = told.select("doc_id", F.lit("").alias("text"), F.col("doc_id").alias("key"), "text_id", "class_id", "n_links").withColumn("part", part("key"))
        rows = rows.union(told.select("doc_id", "text", "key", "part", F.lit(0), F.lit(0), "text_id", "class_id", "n_links"))
    rows = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "ghost", F.desc("key"), "kind", "text")
    return rows.mapInPandas(_edited_rows, _EDITED)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes((text or "").lower().split()), width))


def signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS) -> DataFrame:
    """(doc_id, text_id binary, bands binary): digest of the distinct shingles and the places of all bands, of each row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_id": [text_id(s) for s in sets], "bands": [places(minima(s))[: bands * BAND].tobytes() for s in sets]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, text_id binary, bands binary")


def near_duplicates(docs: DataFrame, like: float = LIKE, width: int = WIDTH, block: int = GROUP, bands: int = BANDS) -> DataFrame:
    """(doc_id, text_id, class_id, n_links): classes of texts whose Jaccard similarity is ``like`` or more.

    Texts that share a band are chained to groups, in which whole shingle sets decide every pair. n_links
    counts the verified forest edges of the row's text; class_id is the smallest doc_id that links reach
    (null, with no links, for rows without a doc_id whose text no named row has).
    """
    own = table(signatures(docs, width, bands), "minhash-signatures")
    texts = numbered(own.where("doc_id is not null").groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "minhash-texts")
    values = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("bands"), i * (2 * BAND) + 1, F.lit(2 * BAND))))
    groups = components(chained(texts.select("node", F.explode(values).alias("key")), "minhash-chains"), "minhash-groups")
    near = lambda sketches, x: (sketches.view(np.uint16) == x.view(np.uint16)).mean(axis=1) >= like - 0.2  # noqa: E731  # over 4 standard errors
    edges = table(true_links(docs, groups, texts, lambda t: shingle_set(t, width), lambda s: places(minima(s)), near, like, block), "minhash-links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = least_ids(texts, components(edges, "minhash-parts")).join(ends, "node")
    named = texts.join(linked, "node", "left").select("text_id", F.coalesce("least", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    found = own.select("doc_id", "text_id").join(named, "text_id", "left").select("doc_id", "text_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    found = table(found, "minhash-classes")
    for done in (own, texts, edges):
        drop_table(done)
    return found
