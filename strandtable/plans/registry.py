"""Registered queries: each binds an operator to views of the given tables, with SQL to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Source:
    """Views and tables of one data folder: ``v("counts")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, uses: str = "") -> Callable:
    """Register ``f(v)``; ``sql`` is its check over the views that ``uses`` names."""
    def keep(f: Callable[[Source], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            ORACLE[name] = (ctes(*uses.split()) if uses else "") + sql.strip()
        return f

    return keep


def r6(column: Column | str) -> Column:
    """Rounded for comparison: sums are added in another order elsewhere."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)
