"""op8 and op10: models trained on rows that are not held out, used on every document.

SQL cannot train them; tests check accuracy on the rows held out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorlake.llm import langid, quality
from tutorlake.llm.common import held_out, table


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.train(docs))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {"op8_langid": op8_langid, "op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}
