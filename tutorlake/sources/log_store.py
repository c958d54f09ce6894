"""The interaction log as a table that batches of rows are merged into, by key.

``days`` holds the rows partitioned by day, ``keys`` the day and time of each key, partitioned by a
bucket of the key. A batch reads the buckets of its own keys, and of the days only those that its
rows come to or leave; the same partitions are written anew, no others. The newest row of a key
counts, of equally new ones the one that sorts last, so a batch that comes twice, or again after a
failure half way, leaves what it left before. A stream's batches are told apart by their number: one
that is done is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlake.operators.memory import upsert as newest
from tutorlake.sources.shared import kept

BUCKETS = 32


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def _day(at: str) -> Column:
    return F.coalesce(F.to_date(at).cast("string"), F.lit("none"))


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def read(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """The rows of the log; ``since`` (a date) prunes the days. Rows without a time have no day."""
    if not _exists(spark, f"{path}/days"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, day string").parquet(f"{path}/days")
    return (rows if since is None else rows.where((F.col("day") >= since) & (F.col("day") != "none"))).drop("day")


def merge(batch: DataFrame, path: str, key: str = "id", at: str = "created_at") -> list[str]:
    """Merges a batch into the log; the days that were written."""
    spark = batch.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    batch = kept(newest(batch.where(F.col(key).isNotNull()), key, at).withColumns({"day": _day(at), "bucket": _bucket(key)}))
    kind = batch.schema[key].dataType.simpleString()
    known = spark.createDataFrame([], f"id {kind}, day string, bucket int")
    if _exists(spark, f"{path}/keys"):
        buckets = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # BUCKETS at most
        known = spark.read.schema(known.schema).parquet(f"{path}/keys").where(F.col("bucket").isin(buckets))
    known = kept(known)
    before = known.select(F.col("id").alias("known_id"), F.col("day").alias("was"))
    mine = batch.select(F.col(key).alias("id"), "day").join(before, F.col("id") == F.col("known_id"), "left")
    days = sorted({r["d"] for r in mine.select(F.explode(F.array_compact(F.array("day", "was"))).alias("d")).distinct().collect()})
    if not days:
        return []
    rows = batch.drop("bucket")
    if _exists(spark, f"{path}/days"):
        old = spark.read.schema(f"{schema}, day string").parquet(f"{path}/days").where(F.col("day").isin(days))
        rows = rows.unionByName(old)
    merged = kept(newest(rows, key, at))
    merged.repartition("day", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/days")
    left = set(days) - {r["day"] for r in merged.select("day").distinct().collect()}
    for day in left:  # all rows of the day have moved to others
        where, fs = _path(spark, f"{path}/days/day={day}")
        fs.delete(where, True)
    now = merged.select(F.col(key).alias("id"), F.col("day").alias("is")).join(batch.select(F.col(key).alias("batch_id")), F.col("id") == F.col("batch_id"), "left_semi")
    both = known.select("id", "day").join(now, "id", "full_outer").select("id", F.coalesce("is", "day").alias("day"))
    both = kept(both.withColumn("bucket", _bucket("id")))
    both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/keys")
    return days


def sink(path: str, key: str = "id", at: str = "created_at") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges each batch once. One stream writes to a log."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = -1
        if _exists(spark, f"{path}/batches"):
            done = spark.read.parquet(f"{path}/batches").agg(F.max("number")).first()[0]
        if number > done:
            merge(batch, path, key, at)
            spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(f"{path}/batches")

    return write
