"""Hierarchies given as edges (parent, child), and components of graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import row_places
from ..functions.storage import settle

MOST_LEVELS = 1000


def closure(edges: DataFrame, seeds: DataFrame, down: bool = True) -> DataFrame:
    """(seed, node, depth): all nodes below (or above) each seed, itself at 0, with the fewest edges.

    One frontier join per level; nodes reached before are left out, so cycles end.
    """
    a, b = ("parent", "child") if down else ("child", "parent")
    steps = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null").distinct()
    front = settle(seeds.select(F.col("node").alias("seed")).where("seed is not null").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    levels = [front]
    for level in range(1, MOST_LEVELS):
        # A level writes what it adds; now and then the levels so far become one table, so that plans stay short.
        if len(levels) == 32:
            levels = [settle(reduce(DataFrame.union, levels))]
        reached = front.join(steps, F.col("node") == F.col("_a")).select("seed", F.col("_b").alias("node")).distinct()
        known = reduce(DataFrame.union, levels)
        front = settle(reached.join(known.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(level).alias("depth")))
        if front.isEmpty():
            return known
        levels.append(front)
    raise RuntimeError(f"over {MOST_LEVELS} levels")


def distance(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``distance`` of (parent, child) pairs: fewest edges down; null if not below."""
    below = closure(edges, pairs.select(F.col("parent").alias("node")))
    return pairs.join(below.select(F.col("seed").alias("parent"), F.col("node").alias("child"), F.col("depth").alias("distance")), ["parent", "child"], "left")


def _meetings(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kinds (node, kind) of ``seeds``, the best meeting (kind_a, kind_b, m) of two kinds, and lines (below, above, d) between seeds.

    Seeds with the same ancestors at the same depths are one kind, so what two of them share is found once for their kinds. Seeds
    without ancestors have none. ``m`` is (distance plus 1, ancestor).
    """
    up = settle(closure(edges, seeds, down=False).where("depth > 0"))
    listed = up.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("node", "depth"))).alias("above"))
    firsts = settle(row_places(listed.groupBy("above").agg(F.min("seed").alias("first")), [F.col("first")], [], "kind").withColumn("kind", F.col("kind").cast("int")))
    kinds = settle(listed.join(firsts, "above").select(F.col("seed").alias("node"), "kind"))
    rows = firsts.select("kind", F.inline("above"))
    side = lambda x: rows.select(F.col("kind").alias(f"kind_{x}"), "node", F.col("depth").alias(f"d_{x}"))
    m = F.min(F.struct((F.col("d_a") + F.col("d_b") + 1).alias("d"), "node")).alias("m")
    best = settle(side("a").join(side("b"), "node").groupBy("kind_a", "kind_b").agg(m))
    lines = settle(up.join(seeds.select("node"), "node", "left_semi").select(F.col("seed").alias("below"), F.col("node").alias("above"), F.col("depth").alias("d")))
    return kinds, best, lines


def _met(pairs: DataFrame, best: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b, ancestor, distance) of pairs (a, b, kind_a, kind_b), by their kinds or along the line between them."""
    ways = [F.col("m")]
    out = pairs.join(best, ["kind_a", "kind_b"], "left")
    if not lines.isEmpty():
        for x, y in (("a", "b"), ("b", "a")):
            line = lines.select(F.col("below").alias(x), F.col("above").alias(y), F.struct((F.col("d") + 1).alias("d"), F.col("above").alias("node")).alias(f"line_{x}"))
            out = out.join(line, ["a", "b"], "left")
            ways.append(F.col(f"line_{x}"))
    ways.append(F.when(F.col("a") == F.col("b"), F.struct(F.lit(1).alias("d"), F.col("a").alias("node"))))
    m = F.least(*ways)
    return out.select("a", "b", F.coalesce(m["node"], F.lit("")).alias("ancestor"), F.coalesce(m["d"], F.lit(-1)).alias("distance"))


def closest_common_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor, distance): shared ancestor with the fewest edges to both, plus 1; none: '' and -1."""
    pairs = settle(pairs.select("a", "b").distinct())
    kinds, best, lines = _meetings(edges, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    for x in ("a", "b"):
        pairs = pairs.join(kinds.select(F.col("node").alias(x), F.col("kind").alias(f"kind_{x}")), x, "left")
    return _met(pairs, best, lines)


def closest_common_ancestors(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """``closest_common_ancestor`` of all pairs (a before b) of listed terms, which are as many as the square of the terms.

    Pairs are made where they are returned: neither they nor what they share is sorted or shuffled, as long as kinds are few.
    """
    t = settle(terms.select("node").where("node is not null").distinct())
    kinds, best, lines = _meetings(edges, t)
    named = settle(t.join(kinds, "node", "left"))
    # Few terms make many pairs: they are dealt out by number, whatever their size.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda x: named.select(F.col("node").alias(x), F.col("kind").alias(f"kind_{x}"))
    return _met(side("a").repartition(parts).join(side("b"), F.col("a") < F.col("b")), best, lines)


def pairwise_distance(edges: DataFrame, terms: DataFrame, cross: bool = True) -> DataFrame:
    """(a, b, distance) of listed terms: edges if one is above the other, else over a common ancestor (``cross``), else -1."""
    t = terms.select("node").distinct()
    pairs = t.select(F.col("node").alias("a")).join(t.select(F.col("node").alias("b")), F.col("a") < F.col("b"))
    up = closure(edges, t, down=False)
    line = lambda x, y: up.select(F.col("seed").alias(x), F.col("node").alias(y), F.col("depth").alias(f"d_{x}"))
    out = pairs.join(line("a", "b"), ["a", "b"], "left").join(line("b", "a"), ["a", "b"], "left")
    direct = F.coalesce("d_a", "d_b")
    if not cross:
        return out.select("a", "b", F.coalesce(direct, F.lit(-1)).alias("distance"))
    met = up.select(F.col("seed").alias("a"), "node", F.col("depth").alias("x")).join(up.select(F.col("seed").alias("b"), "node", F.col("depth").alias("y")), "node").where("a < b").groupBy("a", "b").agg((F.min(F.col("x") + F.col("y")) + 1).alias("over"))
    return out.join(met, ["a", "b"], "left").select("a", "b", F.coalesce(direct, "over", F.lit(-1)).alias("distance"))


def leaf_terms(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Listed terms with no listed term below."""
    up = closure(edges, terms, down=False).where("depth > 0")
    return terms.select("node").distinct().join(up.select("node"), "node", "left_anti")


def shared_ancestors(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(node, leaves): ancestors of more than one leaf term."""
    up = closure(edges, leaf_terms(edges, terms), down=False).where("depth > 0")
    return up.groupBy("node").agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1")


def simplify_terms(edges: DataFrame, terms: DataFrame, most: int = 3) -> DataFrame:
    """(node, cluster, representative) of listed terms, merged step by step from the leaves up.

    A leaf is a listed term with none below. Ancestors of several leaves step aside. Each leaf's cluster grows by the listed
    ancestor nearest to its top (ties by name), which becomes the top; if that is over ``most`` edges away, it begins a
    cluster of its own instead, which grows on. Then each lowest of the terms that stepped aside takes in, with itself as top, the clusters whose
    tops are below it within ``most`` edges; a cluster in reach of several goes to the first by name. Terms that no cluster came by
    are clusters of their own; terms aside that took in nothing are left out. The representative is the top; clusters are
    numbered by it. All leaves step in one round, so rounds are as many as the longest chain of listed terms.
    """
    t = settle(terms.select("node").where("node is not null").distinct())
    up = settle(closure(edges, t, down=False).where("depth > 0").join(t, "node", "left_semi").select(F.col("seed").alias("below"), "node", "depth"))
    leaves = settle(t.join(up.select("node"), "node", "left_anti"))
    owners = settle(up.join(leaves.select(F.col("node").alias("below")), "below", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("below").alias("leaf")))
    aside = owners.where("n > 1").select("node")
    own = owners.where("n = 1").select("node", "leaf")
    front = leaves.select(F.col("node").alias("leaf"), F.col("node").alias("start"), F.col("node").alias("top"), F.lit(0).alias("step"))
    taken = settle(front)
    step = 0
    while True:
        step += 1
        near = front.join(up.withColumnRenamed("below", "top"), "top").join(own, ["node", "leaf"]).join(taken.select("leaf", F.col("top").alias("node")), ["leaf", "node"], "left_anti")
        best = near.groupBy("leaf", "start").agg(F.min(F.struct("depth", "node")).alias("m"))
        front = settle(best.select("leaf", F.when(F.col("m.depth") <= most, F.col("start")).otherwise(F.col("m.node")).alias("start"), F.col("m.node").alias("top"), F.lit(step).alias("step")))
        if front.isEmpty():
            break
        taken = settle(taken.union(front))
    lone = own.join(taken.select(F.col("top").alias("node")), "node", "left_anti").select("node").union(t.join(leaves, "node", "left_anti").join(owners, "node", "left_anti"))
    members = taken.select(F.col("top").alias("node"), "start").union(lone.select("node", F.col("node").alias("start")))
    tops = taken.groupBy("start").agg(F.max_by("top", "step").alias("top")).union(lone.select(F.col("node").alias("start"), F.col("node").alias("top")))
    lowest = aside.join(up.join(aside.select(F.col("node").alias("below")), "below", "left_semi").select("node"), "node", "left_anti")
    taking = taken.groupBy("start").agg(F.max_by("top", "step").alias("below")).join(up.where(F.col("depth") <= most), "below").join(lowest, "node", "left_semi").groupBy("start").agg(F.min("node").alias("over"))
    tops = settle(tops.join(taking, "start", "left").select("start", F.coalesce("over", "top").alias("representative"), F.col("over").isNotNull().alias("taken")))
    placed = members.join(tops, "start").select("node", "representative").union(tops.where("taken").select("representative", "representative").distinct())
    numbers = row_places(tops.select("representative").distinct(), [F.col("representative")], [], "cluster")
    return placed.join(numbers, "representative").select("node", F.col("cluster").cast("int").alias("cluster"), "representative")


def term2gene(edges: DataFrame, annotation: DataFrame) -> DataFrame:
    """(term, gene): genes of each term and of all terms below it."""
    terms = edges.select(F.explode(F.array("parent", "child")).alias("node")).union(annotation.select("term"))
    below = closure(edges, terms.distinct())
    return below.select(F.col("seed").alias("term"), F.col("node").alias("_t")).join(annotation.select(F.col("term").alias("_t"), "gene"), "_t").select("term", "gene").distinct()


def name_hierarchy(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Ids of both ends replaced by names where known (names: id, name)."""
    out = edges
    for end in ("parent", "child"):
        out = out.join(names.select(F.col("id").alias(end), F.col("name").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return out.select("parent", "child")


def lookup(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return rows.join(names, key, "left")


def label_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b): smallest node, by neighbour minima with pointer jumps."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = settle(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = labels.join(near, "node", "left").select("node", F.least("component", "m").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("_c"))
        after = settle(new.join(jump, "component", "left").select("node", F.coalesce("_c", "component").alias("component")))
        if after.join(labels.withColumnRenamed("component", "_old"), "node").where("component <> _old").isEmpty():
            return after
        labels = after
