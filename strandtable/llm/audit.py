"""How five text filters interact, in every order in which they can be applied.

A document fails some of the filters A to E: a mask of five bits. In an order of filters it is removed at the
first one that it fails. So a mask stands for a packed counter, an integer with one field for each of the 600
steps (120 orders of five), which is 1 where that step removes the document. The sum of the packed
counters of a part holds how many documents each step removes; everything else follows from those fields:
what is kept (all less the removed so far), what fails its filter (the removed where it comes first), what
fails nothing else (the removed where it comes last). Fields are as wide as the number of all rows needs,
so no sum can run over into the next field.

Scale. Texts are read once and leave the scan as a mask and a digest. Copies are counted by (text digest, part)
before the first document of a text is looked up, and equal masks of a part are counted before their counters are
added (n equal integers are n times one), so at most 128 rows a part, hot or not, meet in a task.

Nulls and odd rows: a null text is empty, a null source is the part ''. A null doc_id has no label and
is neither smaller nor larger than another, so it never fails E and makes no other row fail it. Rows of one doc_id
count each, and do not fail E for one another. Several labels of a doc_id count as good (quality 1) or
toxic (1) if one of them is. Extra columns are ignored. An empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """Mask of the filters that look at one text: bit 0 is A, bit 3 is D."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [n < 200, 100 * kinds.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def packed(mask: int, width: int) -> int:
    """The counter of one document: field ``STEPS * order + step`` is 1 where that step removes it."""
    total = 0
    for k, order in enumerate(ORDERS):
        at = next((s for s, f in enumerate(order) if mask >> FILTERS.index(f) & 1), None)
        if at is not None:
            total |= 1 << width * (STEPS * k + at)
    return total


def unpacked(total: int, width: int) -> list[list[int]]:
    """The fields of a sum, for each order and step."""
    low = (1 << width) - 1
    return [[total >> width * (STEPS * k + s) & low for s in range(STEPS)] for k in range(len(ORDERS))]


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by failed filters and labels."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("mask"))
    keys = ["digest", "part", "mask"]
    # Rows of one document are one row from here on.
    rows = table(seen.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = rows.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id").fillna(False, ["good", "toxic"])
    nameless = rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = known.unionByName(nameless).groupBy(*keys, "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"), first.alias("first"))
    copies = table(copies, "audit-copies")
    least = copies.groupBy(F.col("digest").alias("_digest")).agg(F.min("first.doc_id").alias("least"))
    both = copies.join(least, F.col("digest") == F.col("_digest"))
    stay = F.col("free") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), stay.alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - stay).alias("n")))
    counts = both.select("part", "good", "toxic", F.explode(split).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    return counts.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: what the step keeps, removes and would have removed, and what it costs."""
    counts = table(mask_counts(docs, labels), "audit-masks")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = max(1, int(total).bit_length())
    counters = {m: packed(m, width) for m in range(1 << len(FILTERS))}

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        def added(some: pd.DataFrame) -> list[list[int]]:
            return unpacked(sum(int(n) * counters[int(m)] for m, n in zip(some["mask"], some["n"], strict=True)), width)

        n, gone, good, toxic = int(rows["n"].sum()), added(rows), added(rows[rows["good"]]), added(rows[rows["toxic"]])
        fails = {o[0]: gone[k][0] for k, o in enumerate(ORDERS)}
        alone = {o[-1]: gone[k][-1] for k, o in enumerate(ORDERS)}
        shapley = {f: sum(gone[k][o.index(f)] for k, o in enumerate(ORDERS)) for f in FILTERS}
        out = [
            (rows["part"].iloc[0], o, s + 1, n - sum(gone[k][: s + 1]), gone[k][s], fails[f] - gone[k][s], alone[f], good[k][s], toxic[k][s], shapley[f])
            for k, o in enumerate(ORDERS) for s, f in enumerate(o)
        ]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return counts.groupBy("part").applyInPandas(sums, _SCHEMA)
