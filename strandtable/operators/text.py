"""Notes, tags and resource selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import cosine_pairs


def notes_section(text: Column, mark: str = "### Notes") -> Column:
    """What follows the last mark; the whole text without one."""
    return F.trim(F.element_at(F.split(text, mark), -1))


# White space as Unicode's space separators, which is what SQL's trim takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def bullet_lines(text: Column, assistant: str = "<assistant>") -> Column:
    """Trimmed non-empty lines inside ``<summary>`` tags, after the assistant's mark."""
    after = F.element_at(F.split(text, assistant), -1)
    inner = F.when(F.contains(after, F.lit("<summary>")), F.split(F.element_at(F.split(after, "<summary>"), 2), "</summary>")[0]).otherwise(after)
    return F.filter(F.transform(F.split(inner, "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")


def match_tags(queries: DataFrame, tags: DataFrame, limit: float = 0.5) -> DataFrame:
    return cosine_pairs(queries, tags, limit)


def select_labels(scores: DataFrame, limit: float = 0.25) -> DataFrame:
    """(text_id, labels): labels whose given score reaches ``limit``."""
    return scores.where(F.col("score") >= limit).groupBy("text_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def select_resources(manifest: DataFrame, scopes: list[str], descriptions: list[str]) -> DataFrame:
    """Resources with any chosen scope and a chosen description: folder of matched scopes, and copy, clone or skip."""
    tags = F.filter(F.split("scope_of_work", r"; ?"), lambda t: t != "")
    matched = F.array_intersect(F.array(*map(F.lit, scopes)), tags) if scopes else F.array().cast("array<string>")
    action = F.when(F.col("location").isNull() | (F.col("location") == ""), "skip").when(F.col("location").startswith("git@"), "clone").otherwise("copy")
    rows = manifest.withColumn("matched", matched).where((F.size("matched") > 0) & F.col("description").isin(descriptions))
    return rows.select("software", F.array_join("matched", "_").alias("folder"), "location", action.alias("action")).distinct()


def unknown_scopes(choice: list[str], tags: DataFrame) -> DataFrame:
    """Chosen tags that no resource has."""
    return tags.sparkSession.createDataFrame([(c,) for c in choice], "tag string").distinct().join(tags.select("tag"), "tag", "left_anti")
