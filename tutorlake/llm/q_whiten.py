"""op13: whitened embeddings. SQL has no eigenvectors; tests compare with numpy's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorlake.llm import whiten
from tutorlake.llm.common import table


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whiten": op13_whiten}
ORACLE_SQL: dict[str, str] = {}
