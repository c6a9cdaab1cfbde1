"""Mixing sources to target weights by min-cost flow.

Documents of one membership pattern (the set of sources that they belong to) are interchangeable, so the
flow runs over patterns: from the start to each pattern with as much capacity as its words for each
copy, the n-th copy costing n squared (convex, so repetition is spread evenly), from a pattern to its
sources, and from each source to the end with the source's target. Its cheapest maximum flow says how
many words of each pattern the mix takes. Whole copies go to every document of the pattern; the rest goes
to seeded documents until it is reached most nearly, so a pattern misses its words by half a document at
most. Reruns agree: the order depends on doc_id and seed alone.

Scale. Documents are read once into (doc_id, sources, size); sums by pattern are combined before the
shuffle, and the driver sees one row for each pattern (``MOST_PATTERNS``; more raise an error). They
are routed in layered maximum flows, one for each copy, in seconds at that bound. The last seeded documents are found
by digit sums (``common.first_by_weight``): no source is sorted or gathered, however hot.

Nulls and odd rows: a null text has size 0; a null source is a source of its own, the last; repeated rows
count each time and are chosen each on its own; documents without words take nothing. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_weight, seeded, table

WORDS = r"[^\x20\x09-\x0D]+"
COPIES = 3
#: Patterns that the driver routes. They grow with the combinations of sources, not with documents.
MOST_PATTERNS = 100_000


def targets(sizes: dict, weights: dict, copies: int = COPIES) -> dict[object, float]:
    """Shares of the total by weight; none above ``copies`` times its size, the excess shared again."""
    total, share, capped = sum(sizes.values()), {}, {}
    free = set(sizes)
    while free:
        left, weight = total - sum(capped.values()), sum(weights[s] for s in free)
        share = {s: left * weights[s] / weight for s in free}
        over = {s for s in free if share[s] > copies * sizes[s]}
        if not over:
            break
        capped |= {s: copies * sizes[s] for s in over}
        free -= over
    return {s: float(v) for s, v in (share | capped).items()}


def route(patterns: dict[tuple, int], quotas: dict, copies: int = COPIES) -> dict[tuple, dict]:
    """Words that each source takes from each pattern: a cheapest maximum flow.

    Costs lie on the arcs from the start alone, and they rise with the copy; so shortest paths are those that
    add a first copy, then a second, and so on, and no path ever takes a copy back (it only passes words of a
    pattern on from one source to another). Each copy is therefore one maximum flow over what the earlier ones
    left, by shortest augmenting paths in layers.
    """
    names = [p for p in patterns if p]
    sources = sorted({s for p in names for s in p}, key=lambda s: (s is None, s or ""))
    place = {s: len(names) + k for k, s in enumerate(sources)}
    links = [[place[s] for s in p] for p in names]  # from a pattern; words flow without limit
    back: list[set] = [set() for _ in sources]  # patterns that a source holds words of
    held: dict[tuple[int, int], int] = {}
    room = [int(quotas[s]) for s in sources]
    n = len(names)
    for _ in range(copies):
        left = [int(patterns[p]) for p in names]
        while True:
            # Layers from all patterns that have words left, up to the sources that have room.
            level = {x: 0 for x in range(n) if left[x]}
            front, open_ = list(level), False
            while front and not open_:
                after = []
                for x in front:
                    for y in links[x] if x < n else back[x - n]:
                        if y not in level:
                            level[y] = level[x] + 1
                            after.append(y)
                            open_ = open_ or (y >= n and room[y - n] > 0)
                front = after
            if not open_:
                break
            todo = {x: iter(links[x] if x < n else list(back[x - n])) for x in level}
            for start in [x for x in range(n) if left[x]]:
                path = [start]
                while path and left[start]:
                    x = path[-1]
                    if x >= n and room[x - n]:
                        amount = min([left[start], room[x - n], *(held[y, z] for z, y in zip(path[1:], path[2:], strict=False) if z >= n)])
                        for z, y in zip(path, path[1:], strict=False):
                            a, b, sign = (z, y, 1) if z < n else (y, z, -1)
                            held[a, b] = held.get((a, b), 0) + sign * amount
                            (back[b - n].add if held[a, b] else back[b - n].discard)(a)
                        left[start] -= amount
                        room[x - n] -= amount
                        path = [start]
                        continue
                    step = next((y for y in todo[x] if level.get(y) == level[x] + 1 and (x < n or held.get((y, x), 0))), None)
                    if step is None:
                        path.pop()
                    else:
                        path.append(step)
    flow: dict[tuple, dict] = {p: {s: held.get((k, place[s]), 0) for s in p} for k, p in enumerate(names)}
    return flow | {p: {} for p in patterns if not p}


def default_weights(sources: list) -> dict:
    """1, 2, 3, repeating, over sources by code point, null last."""
    return {s: k % 3 + 1 for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def mix(docs: DataFrame, weights: dict | None = None, sources: Column | None = None, copies: int = COPIES, seed: int = 1) -> DataFrame:
    """(doc_id, sources array, size, source_size, target, taken) for each row of ``docs``.

    ``sources`` is the array of sources that a row belongs to (by default its ``source`` alone). A
    document of several sources counts to the size of each; source_size and target are sums over them.
    """
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    belongs = F.array_sort(F.array_distinct(F.array(F.col("source").cast("string")) if sources is None else sources))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), belongs.alias("sources"), words.alias("size"))
    rows = table(rows.withColumn("pattern", F.to_json(F.struct("sources"), {"ignoreNullFields": "false"})), "mixing-rows")
    found = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} membership patterns")
    names = {tuple(r["sources"]): r["pattern"] for r in found}
    patterns = {tuple(r["sources"]): r["size"] for r in found}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    goal = targets(sizes, weights or default_weights(list(sizes)), copies)
    flow = route(patterns, {s: int(v + 0.5) for s, v in goal.items()}, copies)
    plan, rest = [], {}
    for p, name in names.items():
        taken = sum(flow[p].values())
        whole = taken // patterns[p] if patterns[p] else 0
        rest[name] = taken - whole * patterns[p]
        plan.append((name, sum(sizes[s] for s in p), float(sum(goal[s] for s in p)), whole))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "pattern string, source_size long, target double, whole long")
    chosen = first_by_weight(rows.withColumn("_order", seeded("doc_id", seed)), "pattern", "_order", "size", rest)
    chosen = chosen.join(F.broadcast(plan), "pattern")  # bounded by MOST_PATTERNS
    taken = F.col("size") * (F.col("whole") + F.col("picked").cast("long"))
    return chosen.select("doc_id", "sources", "size", "source_size", "target", taken.alias("taken"))


def keep_taken(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it. Documents without words, and so without cost, stay once.

    Rows of one doc_id are repeated as often as the most taken of them.
    """
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    mixed = mix(docs, seed=seed).groupBy(F.col("doc_id").alias("_id")).agg(F.max(copies).alias("_copies"))
    mixed = table(mixed.where("_copies > 0"), "mixing-copies")
    rows = docs.join(mixed.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(mixed["_id"]))
    spare = "_" * (1 + max(map(len, docs.columns)))  # no column of docs
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), mixed["_copies"])).alias(spare)).drop(spare)
