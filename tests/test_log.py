"""The log kept by batches, and its index of substrings."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tutorlake.operators import log_index as LI
from tutorlake.operators import memory as M
from tutorlake.plans import q_memory
from tutorlake.sources import log_store as LS
from tutorlake.sources.shared import new_folder

SCHEMA = "id string, question string, solution string, topic string, created_at timestamp"


def some(rng, n, ids=40):
    start = datetime(2024, 1, 1)
    word = lambda: rng.choice(["Sine", "cosine", "x_1", "100%", "äöü", "limit", "of", "a\\b", "derivative"])
    text = lambda: " ".join(word() for _ in range(rng.randint(0, 9)))
    return [(str(rng.randrange(ids)), text(), rng.choice([None, text()]), rng.choice([None, "Algebra"]), rng.choice([None, start + timedelta(hours=rng.randrange(200))])) for _ in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.select("id", "question", "solution", "topic", "created_at").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_batches_are_the_newest_rows(spark, seed):
    """Whatever comes in which batch, and twice; rows move between days, and days become empty."""
    rng = random.Random(seed)
    batches = [some(rng, 30) for _ in range(4)]
    path = f"{new_folder(spark)}/log"
    for b in [*batches[:3], batches[1], batches[3]]:
        LS.merge(spark.createDataFrame(b, SCHEMA), path)
    every = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    assert rows_of(LS.read(spark, path, SCHEMA)) == rows_of(M.upsert(every))
    keys = {r["id"]: r["day"] for r in spark.read.parquet(f"{path}/keys").collect()}
    assert keys == {r["id"]: str(r["created_at"].date()) if r["created_at"] else "none" for r in M.upsert(every).collect()}


def test_other_days_are_not_written(spark):
    path = f"{new_folder(spark)}/log"
    day = lambda d: datetime(2024, 1, d)
    LS.merge(spark.createDataFrame([("a", "q", None, None, day(1)), ("b", "q", None, None, day(2)), ("c", "q", None, None, day(3))], SCHEMA), path)
    files = lambda d: sorted(LS.read(spark, path, SCHEMA).where(F.to_date("created_at") == F.lit(day(d)).cast("date")).select(F.input_file_name()).distinct().collect())
    before = files(3)
    assert LS.merge(spark.createDataFrame([("a", "new", None, None, day(2))], SCHEMA), path) == ["2024-01-01", "2024-01-02"]
    assert files(3) == before and files(1) == [] and len(rows_of(LS.read(spark, path, SCHEMA))) == 3
    assert [r[0] for r in rows_of(LS.read(spark, path, SCHEMA, "2024-01-03"))] == ["c"]
    assert LS.merge(spark.createDataFrame([], SCHEMA), path) == []


def test_stream_into_the_log(spark, tmp_path):
    """A stream that starts again with a batch that is done leaves the log as it is."""
    rows = some(random.Random(5), 60)
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/in")
    path = f"{new_folder(spark)}/log"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    write = LS.sink(path)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    want = rows_of(M.upsert(spark.createDataFrame(rows, SCHEMA)))
    assert rows_of(LS.read(spark, path, SCHEMA)) == want
    write(spark.createDataFrame([("a new one", "q", None, None, None)], SCHEMA), 0)
    assert rows_of(LS.read(spark, path, SCHEMA)) == want


def hits(df):
    return sorted(map(tuple, df.collect()))


def test_substring_index(spark):
    """Wildcards, escapes, short and empty queries, case, marks beyond ASCII; in parts as at once."""
    rng = random.Random(3)
    rows = [(f"{i}", *r[1:]) for i, r in enumerate(some(rng, 300))]
    df = spark.createDataFrame(rows, SCHEMA)
    texts = ["sine", "COSINE", "limit of", "l%t of", "x_1", "x\\_1", "100\\%", "100%sine", "ÄÖÜ", "a", "", "%", "of_lim", "nothing at all", "a\\\\b", "Algebra", "si%co%de", "the", "erivativ", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    want = hits(M.search(queries.where("query is not null"), df, 7))
    LI.append(df, whole := new_folder(spark))
    parts = new_folder(spark)
    for lo, hi in ((0, 120), (100, 220), (0, 300)):
        LI.append(spark.createDataFrame(rows[lo:hi], SCHEMA), parts)
    assert len(want) > 60
    assert hits(LI.search(queries, whole, 7)) == want
    assert hits(LI.search(queries, parts, 7)) == want


@pytest.mark.parametrize("block", [10_000, 3])
def test_search_of_a_batch(spark, block, monkeypatch):
    """As each query alone: wildcards, escapes, empty and equal queries, case, marks beyond ASCII, nulls."""
    rng = random.Random(5)
    df = spark.createDataFrame([(f"{i}", *r[1:]) for i, r in enumerate(some(rng, 300))] + [("n", None, None, None, None), ("m", None, "SINE\nÄÖÜ", None, None)], SCHEMA)
    texts = ["sine", "COSINE", "Sine", "limit of", "l%t of", "x_1", "x\\_1", "100\\%", "100%sine", "ÄÖÜ", "äöü", "a", "", "%", "nothing at all", "a\\\\b", "Algebra", "the", "erivativ", "e\nä", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    want = hits(M.search(queries.where("query is not null"), df, 7))
    monkeypatch.setattr(M, "QUERY_BLOCK", block)
    assert hits(M.search_batch(queries, df, 7)) == want and len(want) > 60
    assert M.search_batch(queries.limit(0), df, 7).count() == M.search_batch(queries, df.limit(0), 7).count() == 0


def test_a_batch_does_not_compare_pairs(spark):
    """Registered searches of the log join no text with a query, and write no index of all grams."""
    plan = q_memory.QUERIES["m5_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "like" not in plan.lower() and "/grams" not in plan


def test_only_what_may_match_is_compared(spark):
    rows = [(f"{i}", "common words here" if i else "a rare zebra", None, None, None) for i in range(500)]
    LI.append(spark.createDataFrame(rows, SCHEMA), path := new_folder(spark))
    asked = LI._asked(spark.createDataFrame([(1, "zebra")], "query_id int, query string"))
    assert LI.candidates(asked, path).count() == 1
    plan = LI.search(spark.createDataFrame([(1, "zebra")], "query_id int, query string"), path)._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and LI.search(spark.createDataFrame([(1, "zebra")], "query_id int, query string"), path).count() == 1


def test_empty_log(spark):
    LI.append(spark.createDataFrame([], SCHEMA), path := new_folder(spark))
    assert LI.search(spark.createDataFrame([(1, "abc")], "query_id int, query string"), path).count() == 0
    assert LS.read(spark, f"{new_folder(spark)}/none", SCHEMA).count() == 0
