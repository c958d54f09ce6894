"""Reading and writing the tables of a knowledge base and of the interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PASSAGES = "array<struct<content_type:string,title:string,content:string,page_number:int,chapter:string,section:string>>"
BOOK = f"book string, total_pages int, all_definitions {PASSAGES}, all_theorems {PASSAGES}, all_examples {PASSAGES}"
CURATED = "title string, type string, content string, keywords array<string>"
PROBLEMS = "id string, user_id string, input_type string, question string, topic string, solution string, confidence double, edited boolean, created_at timestamp"
FEEDBACK = "id bigint, problem_id string, is_correct boolean, created_at timestamp"


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(book, page_idx, text), one row a page."""
    return spark.read.format(kind).load(path).select("book", F.col("page_idx").cast("int").alias("page_idx"), "text")


def read_books(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Passages (book and the passage's columns) of books processed before, one JSON file each
    (or one line each, as Spark writes them)."""
    books = spark.read.schema(BOOK).json(path, multiLine=whole_files)
    every = F.concat(*(F.coalesce(c, F.array().cast(PASSAGES)) for c in ("all_definitions", "all_theorems", "all_examples")))
    return books.select("book", F.explode(every).alias("p")).select("book", "p.*")


def read_curated(spark: SparkSession, folder: str, whole_files: bool = True) -> DataFrame:
    """Curated entries of a folder of JSON arrays; the topic is the file's name."""
    rows = spark.read.schema(CURATED).json(folder, multiLine=whole_files)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("topic"))


def write_passages(passages: DataFrame, path: str, kind: str = "parquet") -> None:
    passages.write.mode("overwrite").partitionBy("book").format(kind).save(path)


def write_kb(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors, and one row that describes them."""
    from tutorlake.operators.books import kb_metadata

    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    kb_metadata(chunks).write.mode("overwrite").parquet(f"{path}/metadata")


def write_topics(rows: DataFrame, path: str) -> None:
    """A folder for each topic; a large topic is written by many tasks."""
    rows.write.mode("overwrite").partitionBy("topic").parquet(path)


def read_topics(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """One topic, of which alone the files are read, or all."""
    rows = spark.read.parquet(path)
    return rows if topic is None else rows.where(F.col("topic") == topic)


def write_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.to_date("created_at")).write.mode("overwrite").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """A log by its schema; ``since`` (a date) prunes the days."""
    rows = spark.read.schema(f"{schema}, day date").parquet(path)
    return (rows if since is None else rows.where(F.col("day") >= F.lit(since).cast("date"))).drop("day")
