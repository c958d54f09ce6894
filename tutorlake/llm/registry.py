"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tutorlake.llm import q_leaks, q_lines, q_media, q_models, q_near, q_pages, q_pii, q_suffixes, q_tokens, q_trie, q_whiten

MODULES = (q_tokens, q_suffixes, q_pages, q_lines, q_media, q_leaks, q_near, q_models, q_pii, q_trie, q_whiten)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
