"""op2: repeated strings of 50 bytes. SQL over every byte of every document would be far slower
than the query; tests compare with a set of all strings on small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlake.llm import suffixes
from tutorlake.llm.common import table


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op2_suffixes": op2_suffixes}
ORACLE_SQL: dict[str, str] = {}
