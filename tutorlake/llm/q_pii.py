"""op9: personal data in documents. Tests compare with the plain patterns run one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorlake.llm import pii
from tutorlake.llm.common import table


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


QUERIES = {"op9_pii": op9_pii}
ORACLE_SQL: dict[str, str] = {}
