"""Sharding by balanced label propagation.

Documents are linked through hubs (here: equal texts); two linked documents in different shards are a cut.
The first labels deal the documents out in even runs of a seeded order that knows nothing of texts (only
hubs larger than a shard, which no shard can hold, are laid out in runs of their own). Then, in each round,
every linked document asks for the shard in which most of its hub's documents are (ties by a seeded hash),
and asks are granted under quotas: a move needs a move back between the same two shards, by documents that
ask for it or by unlinked ones. Row counts therefore stay at most one apart in every round (law ``rows``).
Rounds end when nothing is asked or granted.

Scale. Rounds are hub sums (combined before the shuffle), a join with the hubs that still lie in several
shards (few after the first round, then broadcast by Spark if small) and a shard-to-shard table of at
most ``shards`` squared rows on the driver. Grants take the first documents of a seeded order by digit
sums, and places in the order or in a shard come from range partitions plus offsets: neither a shard nor
a hub, however large, is gathered. Texts are read once.

Nulls and odd rows: a null text is empty; equal rows are linked like any equal texts and get slots of
their own; null doc_ids come first in the order. Extra columns are ignored. Shards may stay empty if
there are fewer rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, first_by_weight, ranked, seeded, table

SHARDS = 40
ROUNDS = 8
#: The driver holds a count for each pair of shards.
MOST_SHARDS = 2048


def _quotas(asked: dict[tuple[int, int], int], spare: dict[int, int]) -> tuple[dict, dict]:
    """Grants for asks (from, to), and moves of unlinked rows (from, to) that balance them."""
    grants = {k: min(n, asked.get(k[::-1], 0)) for k, n in asked.items()}
    fill: dict[tuple[int, int], int] = {}
    for (a, b), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - grants[a, b], spare.get(b, 0))
        if more:
            grants[a, b] += more
            fill[b, a] = fill.get((b, a), 0) + more
            spare[b] -= more
    return {k: n for k, n in grants.items() if n}, fill


def propagate(rows: DataFrame, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """Move rows (with ``rank``, ``hub``, ``shard``) for up to ``rounds`` rounds; row counts stay."""
    for n in range(rounds):
        counts = rows.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
        tie = F.xxhash64(F.lit(seed), "hub", "shard")
        best = counts.groupBy("hub").agg(F.max_by("shard", F.struct(F.col("n"), tie)).alias("best"), F.sum("n").alias("linked"), F.count(F.lit(1)).alias("spread"), F.min("rank").alias("rank"))
        best = table(best.where("spread > 1 or linked = 1"), "shards-hubs")
        # Hubs within one shard ask for nothing; a hub of one row is that row.
        asks = rows.join(best.where("spread > 1").select("hub", "best"), "hub").where("shard <> best").select("rank", F.concat_ws(":", "shard", "best").alias("way"))
        asks = table(asks.withColumn("order", seeded("rank", seed + n)).withColumn("one", F.lit(1)), "shards-asks")
        way = lambda text: tuple(int(x) for x in text.split(":"))
        asked = {way(r["way"]): r["count"] for r in asks.groupBy("way").count().collect()}
        if not asked:
            break
        alone = best.where("linked = 1").select("rank", F.col("best").alias("shard"), seeded("rank", seed + n).alias("order"), F.lit(1).alias("one"))
        spare = {r["shard"]: r["count"] for r in alone.groupBy("shard").count().collect()}
        grants, fill = _quotas(asked, spare)
        if not grants:
            break
        moves = first_by_weight(asks, "way", "order", "one", {f"{a}:{b}": x for (a, b), x in grants.items()})
        moves = moves.where("picked").select("rank", F.element_at(F.split("way", ":"), 2).cast("int").alias("to"))
        if fill:
            starts: dict[int, int] = {}
            spans = []
            for (a, b), x in sorted(fill.items()):
                spans.append((a, b, starts.get(a, 0), starts.get(a, 0) + x))
                starts[a] = starts.get(a, 0) + x
            out = first_by_weight(alone, "shard", "order", "one", starts).where("picked").select("rank", "shard", "order")
            spans = rows.sparkSession.createDataFrame(spans, "a int, b int, lo long, hi long")
            out = _placed(out).join(F.broadcast(spans), (F.col("shard") == F.col("a")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
            moves = moves.union(out.select("rank", F.col("b").alias("to")))
        after = table(rows.join(moves, "rank", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "shards-state")
        drop_table(rows)
        rows = after
    return rows


def _placed(out: DataFrame) -> DataFrame:
    """``place`` in each shard's order, gapless from 0."""
    named = out.withColumnRenamed("rank", "row")
    return ranked(named, [F.col("order"), F.col("row")], ["shard"], "shards-fill").withColumnRenamed("rank", "place").withColumnRenamed("row", "rank")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``."""
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards: 1 to {MOST_SHARDS}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    size = (F.octet_length(text) + 16).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("hub"))
    rows = table(rows, "shards-rows")
    total = rows.count()
    # A shard's size bounds the number of larger hubs by the number of shards.
    large = table(rows.groupBy("hub").count().where(F.col("count") > max(1, total // shards)).select("hub", F.lit(True).alias("large")), "shards-large")
    run = F.when(F.col("large"), F.hex("hub")).otherwise(F.lit(""))
    rows = rows.join(F.broadcast(large), "hub", "left").withColumns({"run": run, "order": F.concat(run, seeded("doc_id", seed))})
    rows = ranked(rows.drop("large", "run"), [F.col("order"), F.col("doc_id"), F.col("hub")], [], "shards-order").drop("order")
    rows = table(rows.withColumn("shard", F.expr(f"cast(rank * {shards}L div {max(total, 1)}L as int)")), "shards-first")
    moved = propagate(rows, rounds, seed)
    moved = moved.select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("row"))
    out = ranked(moved, [F.col("row")], ["shard"], "shards-slots")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_pairs(sharded: DataFrame) -> DataFrame:
    """(linked_pairs, cut_pairs) over groups of equal text, from group sums alone."""
    parts = sharded.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    hubs = parts.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return hubs.agg(F.coalesce(pairs, F.lit(0.0)).alias("linked_pairs"), F.coalesce(pairs - F.sum("kept"), F.lit(0.0)).alias("cut_pairs"))
