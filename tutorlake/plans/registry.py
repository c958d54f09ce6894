"""The queries of the reference's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tutorlake.plans import q_books, q_flow, q_memory, q_scores, q_screening, q_search

MODULES = (q_screening, q_memory, q_scores, q_search, q_books, q_flow,)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
