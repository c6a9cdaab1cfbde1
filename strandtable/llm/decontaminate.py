"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

Every document is cut into passages (``WINDOW`` words, starting each ``STRIDE``), and every passage is a
query of its distinct words against the items. Scores are divided by each item's threshold (``SHARE`` of
its score against itself, less for items longer than a passage), so one bound of 1 holds for all items.

The index keeps each term's greatest score, its greatest score in each block of items, and its postings.
A passage's terms are put in the order of their greatest scores; the pivot is the first term at which the
running sum reaches the threshold. No item without a term from the pivot on can pass, so only the lists of
those terms are read (passages without a pivot are done); the blocks that they name stay if their block
bounds and what the terms before the pivot can add at most reach the threshold, then if the block bounds of
all terms do, and only postings in blocks that are left are scored. These steps are taken for many passages
at once, in arrays that hold ``STEP`` list entries at most, instead of by moving cursors. No passage above
the threshold is lost, and there is no limit on what is retrieved. Retrieved pairs are verified on the whole
document: five-word shingles of the item's question (all but its last sentence) and words of its answer (the
last sentence) must be covered.

Scale. Documents are read once for each index part and never shuffled. Collection statistics (document
frequencies, mean length) are Spark aggregates over all items; parts of the index (``PART_BYTES`` of item
text at most, by a hash of the item) are broadcast one by one, and many parts mean several passes.

Nulls and odd rows: null texts and null ids of items are left out, null document texts are empty; items
without words match nothing; repeated items and documents report each once; documents without an id are
reported under a null id and dropped each for its own text. Extra columns are ignored. Empty tables give an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

WINDOW, STRIDE = 40, 20
SHARE = 0.4
K1, B = 1.2, 0.75
OVERLAP = 0.5
WIDTH = 5
#: Items in a block at least, and blocks of an index part at most.
BLOCK, MOST_BLOCKS = 8, 128
#: List entries that are looked at in one step.
STEP = 500_000
PART_BYTES = 8_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _shingles(w: list[str], width: int = WIDTH) -> set[tuple]:
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence is cut at two thirds."""
    parts = [p for p in map(words, _SENTENCE.split(text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = parts[0] if parts else []
    cut = max(1, 2 * len(w) // 3)
    return w[:cut], w[cut:]


class Index:
    """An inverted index of some items with scores in units of each item's threshold."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], n_items: int, mean: float):
        self.ids = [i for i, _ in items]
        self.parts = [question_answer(t) for _, t in items]
        self.block = max(BLOCK, -(-len(items) // MOST_BLOCKS))
        self.n_blocks = max(1, -(-len(items) // self.block))
        lists: dict[str, list] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            w = words(text)
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            raw = {t: np.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            least = SHARE * min(1.0, WINDOW / max(1, len(w))) * sum(raw.values())
            for t, x in raw.items():
                lists[t].append((k, x / least))
        # Terms are numbered by their greatest score, so that a passage's sorted terms come in the pivot's order.
        order = sorted(lists, key=lambda t: (max(x for _, x in lists[t]), t))
        self.terms = {t: k for k, t in enumerate(order)}
        self.most = np.array([max(x for _, x in lists[t]) for t in order] or [0.0])
        size = np.array([len(lists[t]) for t in order], dtype=np.int64)
        self.item = np.array([k for t in order for k, _ in lists[t]], dtype=np.int64)
        self.score = np.array([x for t in order for _, x in lists[t]], dtype=np.float64)
        term = np.repeat(np.arange(len(order)), size)
        self.bounds = np.zeros((max(1, len(order)), self.n_blocks))
        np.maximum.at(self.bounds, (term, self.item // self.block), self.score)
        # Postings are sorted by (term, block): where each such run starts, and which blocks a term has.
        self.run, first, self.run_size = np.unique(term * self.n_blocks + self.item // self.block, return_index=True, return_counts=True)
        self.run_start = first
        self.lists_size = np.bincount(self.run // self.n_blocks, minlength=len(self.most))
        self.lists_start = np.cumsum(self.lists_size) - self.lists_size

    def retrieve(self, texts: list[list[str]]) -> set[tuple[int, int]]:
        """(text, item) of all passages that reach an item's threshold."""
        get = self.terms.get
        size = np.array([len(t) for t in texts], dtype=np.int64)
        term = np.array([get(w, -1) for t in texts for w in t], dtype=np.int64)
        windows = np.maximum(1, -(-np.maximum(size - WINDOW, 0) // STRIDE) + 1)
        base = np.cumsum(windows) - windows
        place = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
        text = np.repeat(np.arange(len(texts)), size)
        keys = []
        for back in range(WINDOW // STRIDE):
            k = place // STRIDE - back
            inside = (k >= 0) & (k < windows[text]) & (term >= 0)
            keys.append((base[text] + k)[inside] * len(self.most) + term[inside])
        passage, term = np.divmod(np.unique(np.concatenate(keys)), len(self.most))
        owner = np.repeat(np.arange(len(texts)), windows)
        found: set[tuple[int, int]] = set()
        for part in _steps(passage, self.lists_size[term]):
            p, item = self._pass(passage[part], term[part])
            found |= set(zip(owner[p].tolist(), item.tolist(), strict=True))
        return found

    def _pass(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) above the threshold, from the sorted distinct terms of some passages."""
        ids, start, count = np.unique(passage, return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(ids)), count)
        whole = np.cumsum(self.most[term])
        before = whole[start] - self.most[term[start]]
        running = whole - before[at]
        after = running >= 1 - 1e-9  # from the pivot on
        rest = np.bincount(at[~after], weights=self.most[term[~after]], minlength=len(ids))  # all that earlier terms can add
        # Blocks that the lists from the pivot on name, with those terms' bounds.
        lists = self.lists_size[term[after]]
        run = _spans(self.lists_start[term[after]], lists)
        key = np.repeat(at[after], lists) * self.n_blocks + self.run[run] % self.n_blocks
        key, which = np.unique(key, return_inverse=True)
        bound = np.bincount(which, weights=self.bounds[np.repeat(term[after], lists), self.run[run] % self.n_blocks], minlength=len(key))
        p, block = np.divmod(key, self.n_blocks)
        open_ = bound + rest[p] >= 1 - 1e-9
        p, block, bound = p[open_], block[open_], bound[open_]
        # The bounds of the earlier terms in those blocks.
        early = np.bincount(at[~after], minlength=len(ids))
        n = early[p]
        who = np.repeat(np.arange(len(p)), n)
        bound = bound + np.bincount(who, weights=self.bounds[term[_spans(start[p], n)], block[who]], minlength=len(p))
        open_ = bound >= 1 - 1e-9
        p, block = p[open_], block[open_]
        # Postings of all terms in the blocks that are open.
        n = count[p]
        who = np.repeat(np.arange(len(p)), n)
        wanted = term[_spans(start[p], n)] * self.n_blocks + block[who]
        run = np.minimum(np.searchsorted(self.run, wanted), max(0, len(self.run) - 1))
        hit = self.run[run] == wanted if len(self.run) else np.zeros(len(run), dtype=bool)
        run, who = run[hit], who[hit]
        posting = _spans(self.run_start[run], self.run_size[run])
        key = p[np.repeat(who, self.run_size[run])] * len(self.ids) + self.item[posting]
        key, which = np.unique(key, return_inverse=True)
        score = np.bincount(which, weights=self.score[posting], minlength=len(key))
        p, item = np.divmod(key[score >= 1 - 1e-9], max(1, len(self.ids)))
        return ids[p], item

    def verify(self, have: set[tuple], width: dict[int, set], vocabulary: set[str], k: int) -> tuple[float, float]:
        """Shares of the item's question shingles and of its answer's words that the document covers."""
        q, a = self.parts[k]
        n = min(WIDTH, len(q))
        shingles = _shingles(q)
        covered = len(shingles & (have if n == WIDTH else width[n])) / len(shingles) if shingles else 1.0
        return covered, len(set(a) & vocabulary) / len(set(a)) if a else 1.0


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of each span, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _steps(passage: np.ndarray, entries: np.ndarray) -> Iterator[slice]:
    """Runs of whole passages with about ``STEP`` list entries each."""
    step = (np.cumsum(entries) // STEP)[np.searchsorted(passage, passage)] if len(passage) else entries
    cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(passage)]
    return (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def _search(index: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = index.value
        for b in slices(batches):
            texts = [words(t) for t in b["text"]]
            ids, rows = b["doc_id"].tolist(), []
            by: dict[int, list[int]] = defaultdict(list)
            for d, k in made.retrieve(texts) if texts else ():
                by[d].append(k)
            for d, items in sorted(by.items()):
                w = texts[d]
                have, vocabulary = _shingles(w), set(w)
                short = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in {min(WIDTH, len(made.parts[k][0])) for k in items} if n < WIDTH}
                for k in sorted(items):
                    q, a = made.verify(have, short, vocabulary, k)
                    if q >= OVERLAP and a >= OVERLAP:
                        rows.append((ids[d], np.uint64(xxhash.xxh64_intdigest(b["text"][d].encode("utf-8", "surrogatepass"), 42)).astype(np.int64), made.ids[k], q, a))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "item_id", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64"})

    return run


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, XXH64 of the text, item_id, question_overlap, answer_overlap) of each row that holds a test item."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    items = items.where(F.col("text").rlike(r"(?U)\w"))

    @F.pandas_udf("array<string>")
    def tokens(text: pd.Series) -> pd.Series:
        return text.map(words)

    split = items.withColumn("words", tokens("text"))
    n, mean, size = split.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.sum(F.octet_length("text"))).first()
    schema = "doc_id long, digest long, item_id long, question_overlap double, answer_overlap double"
    if not n:
        return spark.createDataFrame([], schema)
    parts = -(-int(size) // PART_BYTES)
    split = table(split.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "decontaminate-items")
    frequency = table(split.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "decontaminate-terms")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for part in range(parts):
        own = split.where(F.col("part") == part)
        held = sorted((r["item_id"], r["text"]) for r in own.select("item_id", "text").collect())
        terms = own.select(F.explode("words").alias("term")).distinct()
        counts = {r["term"]: r["n"] for r in frequency.join(terms, "term", "left_semi").collect()}
        index = spark.sparkContext.broadcast(Index(held, counts, n, float(mean)))  # PART_BYTES of text at most
        found.append(rows.mapInPandas(_search(index), schema))
    return reduce(DataFrame.union, found)


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap) of each document that holds a test item."""
    best = [F.max(c).alias(c) for c in ("question_overlap", "answer_overlap")]
    return _found(docs, items).groupBy("doc_id", "item_id").agg(*best)


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text holds no test item."""
    found = table(_found(docs, items).select(F.col("doc_id").alias("_leak"), F.col("digest").alias("_digest")).distinct(), "decontaminate-found")
    own = F.xxhash64(docs["text"].cast("string"))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_leak"]) & (own == found["_digest"]), "left_anti")
