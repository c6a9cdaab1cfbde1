"""Registered queries over the given tables, by family."""

from . import domains, summaries, tables, tests_and_models  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
