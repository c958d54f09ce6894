"""From raw documents to token ids, in five stages; each works on all that the one before kept.

The stages: documents without a language go; repeated lines go (and documents that consist of
them); one document of each class of near duplicates stays; documents that hold a test item go;
the rest becomes token ids, decoded again as a check. Each stage's rows are written to the shared
folder as Parquet and read again.

An empty table gives no row. Null and empty texts go in the first stage. Where no document has a
language to learn from, that stage rejects none, and they go in the second. A table without
``n_chars`` stays one without it; repeated rows stay as often as their stages keep them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlake.llm import bpe, decon, jaccard, langid, lines
from tutorlake.llm.common import materialize, table, unused

#: A document is rejected below this probability of its most likely language.
LEAST_SURE = 0.5
#: Bytes of an Arrow batch, about: a task's JVM holds one outside its heap, its Python worker another.
BATCH_BYTES = 4 << 20


def bounded(stage: Callable) -> Callable:
    """The stage, after which the session hands batches of BATCH_BYTES to Python (Spark's default is 64 MB):
    its rows are only made when they are written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: some letters, and a calibrated probability of a half or more."""
    model = langid.train(docs)
    if model is None:  # no labelled text to learn from: nothing tells that a document has no language
        return docs
    found = unused(docs, "language_found")
    got = docs.withColumn(found, langid.language(docs, model))
    return got.where((F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") >= LEAST_SURE)).select(*docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that repeat an earlier one; documents of which nothing is left go."""
    got = lines.dedup(docs).where(F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near duplicates."""
    return jaccard.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no test item."""
    return decon.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [(name, bounded(stage)) for name, stage in (("language", language_stage), ("lines", lines_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("tokens", tokens_stage))]

#: SQL can express neither the trained language model nor tokens; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
