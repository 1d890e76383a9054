"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import page_queries, split_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (split_queries, text_queries, page_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
