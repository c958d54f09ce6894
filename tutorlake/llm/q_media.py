"""op5: documents stored as JPEG files, read back. SQL has no codecs; tests check the round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorlake.llm import media
from tutorlake.llm.common import table


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(media.store(table(spark, sf_dir, "documents")))


QUERIES = {"op5_media": op5_media}
ORACLE_SQL: dict[str, str] = {}
