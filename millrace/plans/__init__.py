"""Whole queries: the search API, and the registered queries over the given tables with their SQL."""

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
