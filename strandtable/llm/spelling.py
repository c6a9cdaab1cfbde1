"""Spelling variants: words one edit apart, joined through pivotal grams, each led to its most frequent neighbour.

Words one inserted, deleted or replaced code point apart share much of their bigrams. Bigrams are
ordered by how many words have them, rare ones first. A word's prefix is its three first bigrams in that order (and
every further place of the third); its pivots are two of them that do not overlap, chosen by dynamic
programming for the least frequency. One edit spoils one pivot at most, and the pivot that is left is in the prefix of
whichever word's prefix reaches further, so pivots are met with prefixes both ways and no pair is lost.

Position limits. An edit behind the first pivot leaves it at its place counted from the start, with all before it; any
other edit leaves the second pivot at its place counted from the end, with all behind it. On the edit's side, one of two
halves is equal as well. So what is joined on is that equal part, over half of the word, with its side and the other word's
length, not the bigram alone. Candidates are verified by their edit distance inside the join.

Scale. Words are counted in the tasks that read the texts, in dictionaries of bounded size, before the shuffle. The bigrams
that reach the driver are at most 90 x 90 (26 letters and U+00C0 to U+00FF). A word makes 12 pivot keys and, ties of
long repetitive words apart, 12 prefix keys. Forms at least double in frequency, so chains have under
64 links and are followed by six doublings, each an equi join written to the shared folder.

Nulls and odd rows: a null text has no words; a null doc_id stands as empty text in the hash; repeated rows count each.
Extra columns are ignored. An empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many is misspelt on purpose, by its hash.
SPOILT = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Distinct words that a task counts before it hands its counts on.
HELD = 200_000
EDITS, GRAM = 1, 2
#: Code points of the longest word that travels with its keys.
SHORT = 64


def runs(doc_id: str, text: str) -> Counter:
    """The words of one text of at least ``LEAST_LENGTH`` code points, with one run in ``SPOILT`` (by hash) short of a code point."""
    found: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode("utf-8", "replace").lower().decode())).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % SPOILT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            found[run] += n
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words that occur at least ``LEAST_COUNT`` times."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in slices(batches):
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                held.update(runs(doc_id, text))
                if len(held) >= HELD:
                    yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})

    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def bigrams(word: str) -> list[str]:
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each bigram occurs; at most 8100 entries, by the alphabet."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for w in b["word"]:
                held.update(set(bigrams(w)))
        if held:
            yield pd.DataFrame({"gram": list(held.keys()), "k": list(held.values())})

    return {r["gram"]: r["k"] for r in words.select("word").mapInPandas(count, "gram string, k long").groupBy("gram").agg(F.sum("k").alias("k")).collect()}


def prefix(word: str, counts: dict[str, int]) -> list[int]:
    """Places of the ``GRAM * EDITS + 1`` first bigrams, rare ones first, and of the last one's further occurrences, in place order."""
    grams = bigrams(word)
    order = sorted(range(len(grams)), key=lambda i: (counts.get(grams[i], 0), grams[i], i))
    most = GRAM * EDITS + 1
    last = grams[order[most - 1]]
    return sorted(order[:most] + [i for i in order[most:] if grams[i] == last])


def pivots(word: str, places: list[int], counts: dict[str, int]) -> list[int]:
    """``EDITS + 1`` places of the prefix whose bigrams do not overlap, of least total frequency; by dynamic programming."""
    grams = bigrams(word)
    # best[j] after place i: least (frequency, places) of j bigrams among the places so far.
    history: list[tuple[int, list]] = []
    best: list = [(0, [])] + [None] * (EDITS + 1)
    for i in places:
        clear = [(0, [])] + [None] * (EDITS + 1)
        for at, state in reversed(history):
            if at <= i - GRAM:
                clear = state
                break
        after = list(best)
        for j in range(1, EDITS + 2):
            if clear[j - 1] is not None:
                made = (clear[j - 1][0] + counts.get(grams[i], 0), [*clear[j - 1][1], i])
                after[j] = min(made, after[j]) if after[j] is not None else made
        best = after
        history.append((i, best))
    return best[EDITS + 1][1]


def ends(word: str) -> tuple[list[int], list[int]]:
    """Hashes of the word's first ``i`` code points, and of all from ``i`` on, for each ``i``; one pass each way."""
    def running(letters: Iterable[str]) -> list[int]:
        h = xxhash.xxh64()
        out = [h.intdigest() - 2**63]
        for c in letters:
            h.update(c.encode())
            out.append(h.intdigest() - 2**63)
        return out

    return running(word), running(reversed(word))[::-1]


def before_edit(at: int, head: list[int], tail: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """What a word of ``length`` must share with this one if both have a bigram at ``at`` and the edit is behind it.

    What is behind is halved where the other word's is: the edit is in the second half, or the second half is equal too.
    """
    own, rest = len(head) - 1, length - at - GRAM
    half = rest // 2
    if rest >= 0:
        yield 0, head[at + GRAM + half], 0
        if own - (rest - half) >= at + GRAM and rest:
            yield 1, head[at + GRAM], tail[own - (rest - half)]


def after_edit(at: int, head: list[int], tail: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """The same for an edit before the bigram, which the other word has as far from its end."""
    own, rest = len(head) - 1, at + length - (len(head) - 1)
    half = rest // 2
    if rest >= 0:
        if half <= at:
            yield 2, head[half], tail[at]
        if own - (length - half) >= 0 and rest:
            yield 3, tail[own - (length - half)], 0


def _keys(words: DataFrame, counts: dict[str, int], carried: str) -> DataFrame:
    """(pivot, key, carried, n): ``key`` joins a pivot of one word to a prefix bigram of another by what must be equal.

    An edit behind the first pivot leaves that one; any other edit is before the second pivot and leaves that.
    """
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 4096):
            out = []
            for w, c, n in zip(b["word"], b["carried"], b["n"], strict=True):
                places, (head, tail) = prefix(w, counts), ends(w)
                first, last = pivots(w, places, counts)
                for length in range(len(w) - EDITS, len(w) + EDITS + 1):
                    out += [(True, length, *k, c, n) for k in before_edit(first, head, tail, length)]
                    out += [(True, length, *k, c, n) for k in after_edit(last, head, tail, length)]
                for i in places:
                    out += [(False, len(w), *k, c, n) for k in before_edit(i, head, tail, len(w))]
                    out += [(False, len(w), *k, c, n) for k in after_edit(i, head, tail, len(w))]
            if out:
                yield pd.DataFrame(out, columns=["pivot", "length", "side", "one", "two", "carried", "n"])

    found = words.select("word", F.col(carried).alias("carried"), "n").mapInPandas(make, "pivot boolean, length int, side int, one long, two long, carried string, n long")
    return found.select("pivot", F.xxhash64("length", "side", "one", "two").alias("key"), "carried", "n")


def _met(words: DataFrame, counts: dict[str, int], carried: str) -> DataFrame:
    """(a, na, b, nb): what is carried of words a pivot of which meets a prefix of the other."""
    keys = table(_keys(words, counts, carried), "spelling-keys")
    one = keys.where("pivot").select("key", F.col("carried").alias("a"), F.col("n").alias("na"))
    two = keys.where("not pivot").select("key", F.col("carried").alias("b"), F.col("n").alias("nb"))
    return one.join(two, "key").where("a <> b").drop("key")


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), a < b: all pairs of words (word, n) that are exactly one edit apart, each once.

    Short words travel with their keys, so pairs are verified where they meet. Long ones (a repetitive one has a key
    for each of its places) send a digest, and only pairs of digests fetch their words.
    """
    counts = bigram_counts(words)
    apart = F.levenshtein("a", "b", EDITS) == 1
    met = _met(words.where(F.length("word") <= SHORT), counts, "word").where(apart)
    long = words.where(F.length("word") > SHORT - EDITS)
    if not long.isEmpty():
        long = long.withColumn("id", F.sha2("word", 256))
        pairs = _met(long, counts, "id").distinct()
        for side in ("a", "b"):
            pairs = pairs.join(long.select(F.col("id").alias(side), F.col("word").alias(f"_{side}")), side)
        met = met.union(pairs.select(F.col("_a").alias("a"), "na", F.col("_b").alias("b"), "nb").where(apart))
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.select(pick("a", "b").alias("a"), pick("na", "nb").alias("na"), pick("b", "a").alias("b"), pick("nb", "na").alias("nb")).distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the last of each chain of (word, form) rows; chains that end and have under 64 links."""
    now = table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(6):
        step = now.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        after = table(now.join(step, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            break
    return now


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts."""
    words = table(vocabulary(docs), "spelling-words")
    pairs = table(near_words(words), "spelling-pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n"))
    sides = sides.union(pairs.select("b", "nb", "a", "na"))
    best = sides.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    best = table(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = follow(best.where("form is not null"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
