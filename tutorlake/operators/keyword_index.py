"""A stored inverted index for BM25: built once, appended to, and searched without the texts.

A folder holds ``postings``, one row for each term and slot of documents: the chunks of the slot that
have the term, how often, and their sizes, with the largest count and the smallest size, which bound
what any of them can score whatever the corpus statistics are. Rows are partitioned by segment (one
for each append) and by a bucket of the term, so that a search reads the buckets of its terms only.
Rows without a term (bucket -1) list the chunks. ``terms`` has the document frequencies of each
segment, ``segments`` its numbers of chunks and words; a segment counts once its row there is
written, so that a failed append leaves nothing behind that a search would see.

Postings of asked terms are dealt to tasks by groups of GROUP slots, and a group is scored where it is:
scores are not moved, of a search for the best k only those that can be among them. Where asked words
are rare, slots can be left out: the few with the largest sums of bounds are scored first, which gives
each query a score that its k-th hit must reach, and slots whose sum does not reach it are not scored.
The hits are those of scoring everything.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tutorlake.functions.normalize import clean_for_tokens, tokens
from tutorlake.functions.text import once
from tutorlake.operators.search import EPSILON, K1, SMALL, B, bm25_topk
from tutorlake.sources.shared import kept

#: Chunks of a slot, about, and buckets of terms.
SLOT = 128
BUCKETS = 32
#: Slots that a task tokenizes, that it writes of a bucket, and that it scores, about.
TASK, SPREAD, GROUP = 8, 1024, 16
#: Slots of a query that are scored first.
SEEDS = 4
#: Slots up to which all are scored.
FEW = 32 * SEEDS


def _bucket(term: Column) -> Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def append(chunks: DataFrame, path: str, text: str = "content", key: str = "chunk_id") -> None:
    """Adds the chunks whose id the index does not have yet, as a segment of its own; the same batch
    once more changes nothing. A first append makes the index. Of rows with the same id in one
    batch one counts."""
    spark, kind = chunks.sparkSession, chunks.schema[key].dataType.simpleString()
    rows = chunks.select(F.col(key).alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("chunk_id is not null")
    if _exists(spark, f"{path}/segments"):
        listed = _postings(spark, path).where("bucket = -1").select(F.explode("ids").alias("chunk_id"))
        rows = rows.join(listed, "chunk_id", "left_anti")
    slots = max(1, -(-rows.count() // SLOT))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("chunk_id"), F.lit(slots)).cast("int")).repartition(-(-slots // TASK), "slot").dropDuplicates(["slot", "chunk_id"])
    words = once(rows, t=tokens(clean_for_tokens(F.col("text")))).select("slot", "chunk_id", F.size("t").alias("size"), F.explode(F.concat("t", F.array(F.lit(None).cast("string")))).alias("term"))
    counted = words.groupBy("slot", "chunk_id", "size", "term").agg(F.count("*").cast("int").alias("tf"))  # a slot is in one task: no shuffle
    listed = F.sort_array(F.collect_list(F.struct("chunk_id", "tf", "size")))
    by = counted.groupBy("slot", "term").agg(listed.alias("l"), F.max("tf").alias("max_tf"), F.min("size").alias("min_size"), F.sum("size").alias("total"))
    segment = f"s{uuid.uuid4().hex}"  # no number, as Spark guesses the type of partition values
    out = by.select(_bucket(F.col("term")).alias("bucket"), "term", "slot", F.col("l.chunk_id").alias("ids"), F.col("l.tf").alias("tfs"), F.col("l.size").alias("sizes"), F.size("l").alias("n"), "max_tf", "min_size", "total")
    parts = -(-slots // SPREAD)
    out = out.repartition(min((BUCKETS + 1) * parts, slots), "bucket", F.col("slot") % parts).sortWithinPartitions("bucket", "term", "slot")
    out.write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    written = spark.read.schema(out.schema).parquet(f"{path}/postings/segment={segment}")
    terms = written.where("bucket >= 0").groupBy("term").agg(F.sum("n").cast("long").alias("df"))
    terms.write.parquet(f"{path}/terms/segment={segment}")
    numbers = written.where("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chunks"), F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("words"))
    numbers.select(F.lit(segment).alias("segment"), F.lit(kind).alias("kind"), "chunks", "words").coalesce(1).write.mode("append").parquet(f"{path}/segments")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _segments(spark: SparkSession, path: str) -> list:
    return spark.read.parquet(f"{path}/segments").collect()  # a row for each append


def _postings(spark: SparkSession, path: str) -> DataFrame:
    segments = _segments(spark, path)
    schema = f"term string, slot int, ids array<{segments[0]['kind']}>, tfs array<int>, sizes array<int>, n int, max_tf int, min_size int, total long, segment string, bucket int"
    full = [r["segment"] for r in segments if r["chunks"]]  # of a segment without chunks there is no file
    return spark.read.schema(schema).parquet(f"{path}/postings").where(F.col("segment").isin(full)) if full else spark.createDataFrame([], schema)


def stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Corpus (one row: n, avg_size, mean_idf) and terms (term, df, idf), as ``search.bm25_stats``."""
    segments = _segments(spark, path)
    n, words = sum(r["chunks"] for r in segments), sum(r["words"] for r in segments)
    terms = spark.read.schema("term string, df long, segment string").parquet(f"{path}/terms").where(F.col("segment").isin([r["segment"] for r in segments])).groupBy("term").agg(F.sum("df").alias("df"))
    raw = terms.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.coalesce(F.avg("raw"), F.lit(0.0)).alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    corpus = mean.select(F.lit(n).cast("long").alias("n"), F.lit(words / n if n else None).cast("double").alias("avg_size"), "mean_idf")
    return corpus, raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


def _gain(tf: Column, size: Column, avg: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avg))


def _asked(queries: DataFrame, path: str) -> DataFrame:
    """(query_id, term, weight): the terms of each query that the index has."""
    terms = stats(queries.sparkSession, path)[1]
    wanted = queries.select("query_id", F.explode(tokens(clean_for_tokens(F.coalesce("query", F.lit(""))))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return wanted.join(terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))


def _read(asked: DataFrame, path: str) -> tuple[DataFrame, float, int]:
    """The postings of the buckets that hold asked terms, the mean size of a chunk, and the number of parts."""
    spark = asked.sparkSession
    buckets = [r["b"] for r in asked.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # BUCKETS at most
    segments = _segments(spark, path)
    n, words = sum(r["chunks"] for r in segments), sum(r["words"] for r in segments)
    return _postings(spark, path).where(F.col("bucket").isin(buckets)), max(words / n, 1e-9) if n else 1.0, max(1, sum(-(-r["chunks"] // (SLOT * GROUP)) for r in segments))


def _scored(postings: DataFrame, asked: DataFrame, avg: float, tasks: int, only: DataFrame | None = None) -> DataFrame:
    """(segment, part, query_id, chunk_id, score) for the terms of ``asked``, which was written; of the
    slots in ``only`` (query_id, segment, slot) alone if given. Postings are dealt by part, a group of
    slots, and scored there."""
    few = asked.count() <= SMALL
    gain = F.zip_with("tfs", "sizes", lambda tf, size: _gain(tf, size, avg))
    rows = postings.select("segment", "slot", F.floor(F.col("slot") / GROUP).alias("part"), "term", "ids", gain.alias("gains"))
    deal = lambda df: df.repartition(tasks, "segment", "part")
    if few and only is None:  # dealt before terms meet queries, so that each posting is moved once
        rows = deal(rows.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")).join(F.broadcast(asked), "term")
    else:
        rows = rows.join(F.broadcast(asked) if few else asked, "term")
        rows = deal(rows if only is None else rows.join(only, ["query_id", "segment", "slot"]))
    each = rows.select("segment", "part", "query_id", "weight", F.explode(F.arrays_zip("ids", "gains")).alias("p"))
    return each.groupBy("segment", "part", "query_id", F.col("p.ids").alias("chunk_id")).agg(F.sum(F.col("weight") * F.col("p.gains")).alias("score"))


def _best(scored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): of each part, what can be among the first k of a query. Scores are
    divided by the query's best and rounded to nine digits before they are ranked, so those that
    lie below the part's k-th by no more than that count as equal; no score exceeds ``most``."""
    most = asked.groupBy("query_id").agg((F.sum(F.greatest("weight", F.lit(0.0))) * (K1 + 1)).alias("m")).agg(F.max("m")).first()[0] or 0.0
    part = Window.partitionBy("segment", "part", "query_id")
    rows = scored.withColumn("r", F.row_number().over(part.orderBy(F.desc("score"))))
    rows = rows.withColumn("reach", F.max(F.when(F.col("r") == k, F.col("score"))).over(part))
    return rows.where(F.col("reach").isNull() | (F.col("score") >= F.col("reach") - 2e-9 * most)).select("query_id", "chunk_id", "score")


def scores(queries: DataFrame, path: str) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that has a term of the query."""
    asked = kept(_asked(queries, path))
    postings, avg, tasks = _read(asked, path)
    return _scored(postings, asked, avg, tasks).select("query_id", "chunk_id", "score")


def slot_bounds(asked: DataFrame, path: str) -> DataFrame:
    """(query_id, segment, slot, most): no chunk of the slot scores more than ``most``."""
    postings, avg, _ = _read(asked, path)
    best = F.greatest(F.lit(0.0), F.col("weight") * _gain(F.col("max_tf"), F.col("min_size"), avg))
    return postings.select("segment", "slot", "term", "max_tf", "min_size").join(asked, "term").groupBy("query_id", "segment", "slot").agg(F.sum(best).alias("most"))


def top_slots(asked: DataFrame, path: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Scores of the slots with the largest bounds, and the other slots (query_id, segment, slot) that
    can still hold one of the first k."""
    postings, avg, tasks = _read(asked, path)
    bounds = kept(slot_bounds(asked, path).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "segment", "slot"))))
    first = kept(_scored(postings, asked, avg, tasks, bounds.where(F.col("r") <= SEEDS).select("query_id", "segment", "slot")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    reach = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).where("score > 0").select("query_id", F.col("score").alias("reach"))
    rest = bounds.where(F.col("r") > SEEDS).join(reach, "query_id", "left")
    # scores are rounded to nine digits of the best before they are ranked
    return first, rest.where(F.col("reach").isNull() | (F.col("most") * (1 + 1e-8) >= F.col("reach"))).select("query_id", "segment", "slot")


def topk(queries: DataFrame, path: str, k: int, leave_out: bool = False) -> DataFrame:
    """(query_id, rank, chunk_id, score) as ``search.bm25_topk`` of all scores. With ``leave_out`` slots are
    left out by their bounds, unless the index has few; that pays where words are rare. Where most
    slots hold most words, as in the driver's texts, hardly any falls away, and finding that out costs more."""
    asked = kept(_asked(queries, path))
    postings, avg, tasks = _read(asked, path)
    if not leave_out or sum(r["chunks"] for r in _segments(queries.sparkSession, path)) <= SLOT * FEW:
        return bm25_topk(_best(_scored(postings, asked, avg, tasks), asked, k), k)
    first, rest = top_slots(asked, path, k)
    more = _scored(postings, asked, avg, tasks, rest)
    return bm25_topk(_best(first, asked, k).unionByName(_best(more, asked, k)), k)
