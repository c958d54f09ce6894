"""op6: documents that hold passages of the benchmark. SQL has no local alignment; tests compare
with aligning every item with every document of a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlake.llm import decon
from tutorlake.llm.common import table


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decon.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.withColumn("score", F.round("score", 6))


QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLE_SQL: dict[str, str] = {}
