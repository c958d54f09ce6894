"""Queries of sources and sinks (S1 to S7, written and read back), the anchor classifier (G13) and
the batch twins of the streams (T1 to T4). Streams run over the same jobs in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorlake.operators import anchors, books
from tutorlake.plans.inputs import CORRECTIONS, FEEDBACK, PROBLEMS, TEXTS, corrections, feedback, problems, table, texts
from tutorlake.plans.q_books import TYPED, _rows, _typed, pages
from tutorlake.sources import tables as T
from tutorlake.sources.shared import new_folder
from tutorlake.streaming import jobs as J


def s1(s, d):
    pages(s, d).write.parquet(path := new_folder(s) + "/rows")
    return T.read_pages(s, path).select("book", "page_idx", F.length("text").alias("n"))


def s2(s, d):
    kinds = [("all_definitions", "definition", 0), ("all_theorems", "theorem", 1), ("all_examples", "example", 2)]
    row = lambda k: F.struct(F.lit(k).alias("content_type"), "title", "content", "page_number", "chapter", "section")
    # a record holds at most 500 pages of a book
    rows = _rows(s, d).groupBy(F.col("source").alias("book"), F.floor(F.col("page_number") / 500).alias("part")).agg(F.count("*").cast("int").alias("total_pages"), *(F.collect_list(F.when(F.col("passage_id") % 3 == i, row(k))).alias(c) for c, k, i in kinds))
    rows.write.json(path := new_folder(s) + "/rows")
    return T.read_books(s, path, False).groupBy("book", "content_type").agg(F.count("*").alias("n"))


def s3(s, d):
    rows = table(s, d, "benchmark").select(F.lit("Entry").alias("title"), F.lit("formula").alias("type"), F.col("text").alias("content"), F.array(F.lit("k")).alias("keywords"))
    rows.write.json(path := new_folder(s) + "/rows")
    return T.read_curated(s, path, False).select("title", "content", F.size("keywords").alias("n"), (F.col("topic") != "").alias("named"))


def s4(s, d):
    T.write_passages(_rows(s, d).withColumnRenamed("source", "book"), path := new_folder(s) + "/rows")
    return s.read.parquet(path).groupBy("book").agg(F.count("*").alias("n"))


def s5(s, d):
    T.write_kb(_typed(s, d), path := new_folder(s) + "/rows")
    return s.read.parquet(f"{path}/metadata").select("total", F.array_join("topics", ",").alias("topics"))


def s6(s, d):
    T.write_topics(books.topic_rows(_typed(s, d)), path := new_folder(s) + "/rows")
    return T.read_topics(s, path, "algebra").groupBy("topic", "bucket").agg(F.count("*").alias("n"))


def s7(s, d):
    T.write_log(problems(s, d), path := new_folder(s) + "/rows")
    return T.read_log(s, path, T.PROBLEMS, "2023-11-16").select("id", "topic", "confidence")


def g13(s, d):
    e = table(s, d, "embeddings")
    known = e.where("vec_id < 62").select((F.col("label") < 5).alias("is_math"), F.concat(F.lit("t"), "label").alias("topic"), "embedding")
    return anchors.classify(e.select(F.col("vec_id").alias("id"), "embedding"), known).withColumn("confidence", F.round("confidence", 5)).select("id", "is_math", "confidence", "topic")


def t1(s, d):
    return J.screen_stream(texts(s, d)).groupBy("status").agg(F.count("*").alias("n"))


def _marks(s, d):
    return feedback(s, d).withColumn("score", (F.col("id") % 10) / 10)


def t2(s, d):
    got = J.accuracy_windows(_marks(s, d))
    return got.select(F.unix_timestamp("start").alias("start"), "n", F.round("accuracy", 6).alias("accuracy"), F.round("score", 6).alias("score"))


def t3(s, d):
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("created_at"))
    return J.study_sessions(e).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {
    "s1_read_pages": s1,
    "s2_read_books": s2,
    "s3_read_curated": s3,
    "s4_write_passages": s4,
    "s5_write_kb": s5,
    "s6_topics": s6,
    "s7_read_log": s7,
    "g13_anchor_classifier": g13,
    "t1_screen_stream": t1,
    "t2_accuracy_windows": t2,
    "t3_study_sessions": t3,
    "t4_correction_stream": lambda s, d: J.correction_stream(corrections(s, d)),
    "t4_ingest_once": lambda s, d: J.ingest_once(problems(s, d).unionByName(problems(s, d))).select("id", "topic"),
}

ORACLE_SQL = {
    "s1_read_pages": f"WITH {TEXTS} SELECT book, doc_id::INT AS page_idx, length(text) AS n FROM texts",
    "s2_read_books": "SELECT source AS book, ['definition', 'theorem', 'example'][doc_id % 3 + 1] AS content_type, count(*) AS n FROM documents GROUP BY ALL",
    "s3_read_curated": "SELECT 'Entry' AS title, text AS content, 1 AS n, true AS named FROM benchmark",
    "s4_write_passages": "SELECT source AS book, count(*) AS n FROM documents GROUP BY source",
    "s5_write_kb": f"WITH {TYPED} SELECT count(*) AS total, (SELECT string_agg(topic, ',' ORDER BY topic) FROM (SELECT DISTINCT topic FROM kb)) AS topics FROM kb",
    "s6_topics": f"WITH {TYPED} SELECT topic, CASE WHEN content_type = 'definition' THEN 'definitions' WHEN content_type IN ('theorem', 'proof') THEN 'theorems' WHEN content_type = 'solved_example' THEN 'examples' WHEN content_type = 'formula' THEN 'formulas' END AS bucket, count(*) AS n FROM kb WHERE topic = 'algebra' AND content_type <> 'note' GROUP BY ALL",
    "s7_read_log": f"WITH {PROBLEMS} SELECT id, topic, confidence FROM problems WHERE created_at >= TIMESTAMP '2023-11-16'",
    "g13_anchor_classifier": """WITH s AS (SELECT e.vec_id AS id, a.label < 5 AS m, 't' || a.label AS topic, list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings a WHERE a.vec_id < 62),
        r AS (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY s DESC) AS k FROM s),
        v AS (SELECT id, (max(s) FILTER (m) + avg(s) FILTER (m AND k <= 5)) / 2 - (max(s) FILTER (NOT m) + avg(s) FILTER (NOT m AND k <= 5)) / 2 AS d, max_by(topic, s) FILTER (m) AS topic FROM r GROUP BY id)
        SELECT id, 1 / (1 + exp(-12 * d)) >= 0.5 AS is_math, round(1 / (1 + exp(-12 * d)), 5) AS confidence, topic FROM v""",
    "t2_accuracy_windows": f"WITH {FEEDBACK} SELECT epoch(date_trunc('day', created_at))::BIGINT AS start, count(*) AS n, round(avg(is_correct::INT), 6) AS accuracy, round(avg((id % 10) / 10), 6) AS score FROM feedback GROUP BY 1",
    "t3_study_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY user_id",
    "t4_correction_stream": f"WITH {CORRECTIONS} SELECT input_type, original_text, corrected_text, count(*) AS frequency FROM corrections WHERE original_text <> corrected_text GROUP BY ALL",
    "t4_ingest_once": f"WITH {PROBLEMS} SELECT id, topic FROM problems",
}
