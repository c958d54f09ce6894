"""op3: main text of web pages. Tests hold pages whose main text is known block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlake.llm import sitetree
from tutorlake.llm.common import table


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op3_html": op3_html}
ORACLE_SQL: dict[str, str] = {}
