"""A stored index of the log's texts for searches by substring, with % and _ as wildcards.

Rows are dealt into slots of at most SLOT; ``grams`` has a row for each gram of three characters and
slot, with a bit for each row of the slot that has it, partitioned by a bucket of the gram; ``rows`` has
the rows by slot, ``counts`` how many rows have a gram. A query's literal pieces must occur, so all
their grams do: the bits of its RAREST grams are taken together, slot by slot, and only the rows left
are compared with the pattern. Queries without a piece of three characters look at all rows, once for
each block of such queries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tutorlake.functions.text import once
from tutorlake.operators import memory
from tutorlake.sources.shared import kept

GRAM, SLOT, BUCKETS = 3, 62, 32
#: Grams of a query that are looked up, the rarest first.
RAREST = 4


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _grams(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _segments(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segments")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return [r["segment"] for r in spark.read.schema("segment string").parquet(f"{path}/segments").collect()]  # a row for each append


def append(problems: DataFrame, path: str) -> None:
    """Adds problems (id, question, solution, topic, created_at) as a segment. Rows whose id is there
    already are left out, so the same batch once more adds nothing."""
    spark, segment = problems.sparkSession, f"s{uuid.uuid4().hex}"
    rows = problems.select("id", "question", "solution", "topic", "created_at").dropDuplicates(["id"])
    if known := _segments(spark, path):
        rows = rows.join(spark.read.parquet(f"{path}/rows").where(F.col("segment").isin(known)).select("id"), "id", "left_anti")
    rows = kept(rows)
    n = rows.count()
    if not n:
        return
    slots = -(-n // (SLOT // 2))
    by_slot = F.row_number().over(Window.partitionBy("s").orderBy("id")) - 1
    rows = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(slots))).withColumn("at", by_slot)
    # a slot that drew more rows than it has bits goes on in others
    rows = kept(rows.select("id", "question", "solution", "topic", "created_at", (F.col("s") + slots * F.floor(F.col("at") / SLOT)).alias("slot"), (F.col("at") % SLOT).cast("int").alias("bit")))
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in ("question", "solution", "topic")]
    each = once(rows, a=low[0], b=low[1], c=low[2]).select("slot", "bit", F.explode(F.array_distinct(F.concat(_grams(F.col("a")), _grams(F.col("b")), _grams(F.col("c"))))).alias("gram"))
    bits = each.groupBy("gram", "slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).withColumn("bucket", _bucket(F.col("gram")))
    bits = kept(bits)
    bits.repartition("bucket", F.col("slot") % 8).sortWithinPartitions("bucket", "gram", "slot").write.partitionBy("bucket").parquet(f"{path}/grams/segment={segment}")
    bits.groupBy("gram", "bucket").agg(F.sum(F.bit_count("bits")).cast("long").alias("n")).repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts/segment={segment}")
    rows.sortWithinPartitions("slot", "bit").write.parquet(f"{path}/rows/segment={segment}")
    spark.createDataFrame([(segment,)], "segment string").coalesce(1).write.mode("append").parquet(f"{path}/segments")


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, query, grams): grams of the pieces between wildcards and escapes."""
    pieces = F.filter(F.split(F.lower("query"), r"[%_\\]+"), lambda p: F.length(p) >= GRAM)
    return queries.select("query_id", "query", F.array_distinct(F.flatten(F.transform(pieces, _grams))).alias("grams"))


def candidates(asked: DataFrame, path: str) -> DataFrame:
    """(query_id, segment, slot, bit): the rows that have the RAREST grams of a query (query_id, grams)."""
    spark, segments = asked.sparkSession, _segments(asked.sparkSession, path)
    each = kept(asked.select("query_id", F.explode("grams").alias("gram")).withColumn("bucket", _bucket(F.col("gram"))))
    buckets = [r["bucket"] for r in each.select("bucket").distinct().collect()]  # BUCKETS at most
    of = lambda part: spark.read.parquet(f"{path}/{part}").where(F.col("segment").isin(segments) & F.col("bucket").isin(buckets))
    counts = of("counts").groupBy("gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("query_id").orderBy("n", "gram")
    rare = each.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(first)).where(F.col("r") <= RAREST)
    rare = rare.withColumn("wanted", F.count("*").over(Window.partitionBy("query_id"))).select("query_id", "gram", "wanted")
    found = of("grams").select("gram", "segment", "slot", "bits").join(rare, "gram")
    found = found.groupBy("query_id", "segment", "slot").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"), F.first("wanted").alias("wanted")).where("n = wanted and bits <> 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(SLOT - 1)), lambda i: F.getbit("bits", i) == 1)
    return found.select("query_id", "segment", "slot", F.explode(places).alias("bit"))


def search(queries: DataFrame, path: str, n: int = 10) -> DataFrame:
    """(query_id, rank, id) as ``memory.search`` over the indexed rows."""
    spark, segments = queries.sparkSession, _segments(queries.sparkSession, path)
    if not segments:
        return queries.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit("").alias("id"))
    rows = spark.read.parquet(f"{path}/rows").where(F.col("segment").isin(segments))
    asked = kept(_asked(queries.where("query is not null")))
    near = candidates(asked.where(F.size("grams") > 0), path)
    hits = rows.join(near, ["segment", "slot", "bit"]).join(asked.select("query_id", "query"), "query_id").where(memory.holds(F.col("query")))
    order = Window.partitionBy("query_id").orderBy(F.col("created_at").desc_nulls_last(), "id")
    long = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "rank", "id")
    short = asked.where(F.size("grams") == 0).select("query_id", "query")
    return long if short.isEmpty() else long.unionByName(memory.search(short, rows, n))
