"""The streaming jobs over files, against their batch twins."""

from pyspark.sql import functions as F

from tutorlake.plans.inputs import corrections, phrases
from tutorlake.plans.q_flow import _marks
from tutorlake.plans.q_scores import requests, resolutions
from tutorlake.streaming import jobs

SF = "/root/testdata/sf0.001"


def stream(spark, df, path, files=4):
    df.repartition(files).write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(path))


def drain(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_screening(spark, tmp_path):
    rows = phrases(spark, SF)
    got = drain(spark, jobs.screen_stream(stream(spark, rows, tmp_path / "in")).select("doc_id", "status"), tmp_path, "screened")
    want = jobs.screen_stream(rows).select("doc_id", "status")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_windows(spark, tmp_path):
    rows = _marks(spark, SF)
    got = drain(spark, jobs.accuracy_windows(stream(spark, rows, tmp_path / "in"), late="60 days"), tmp_path, "windows", "complete")
    want = jobs.accuracy_windows(rows)
    pick = lambda d: sorted((r["start"], r["n"], round(r["accuracy"], 9)) for r in d.collect())
    assert pick(got) == pick(want)


def test_corrections(spark, tmp_path):
    rows = corrections(spark, SF)
    got = drain(spark, jobs.correction_stream(stream(spark, rows, tmp_path / "in")), tmp_path, "corrected", "complete")
    assert got.exceptAll(jobs.correction_stream(rows)).isEmpty() and got.count() > 0


def test_ingest_once(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 20).cast("string").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("created_at"))
    got = drain(spark, jobs.ingest_once(stream(spark, rows, tmp_path / "in")), tmp_path, "once")
    assert got.count() == 20


def test_reviews_in_time(spark, tmp_path):
    a, b = requests(spark, SF), resolutions(spark, SF)
    joined = jobs.reviews_in_time(stream(spark, a, tmp_path / "a"), stream(spark, b, tmp_path / "b"), late="60 days")
    got = drain(spark, joined, tmp_path, "reviews").where("status <> 'auto_skipped'")
    from tutorlake.operators.review import resolved_in_time

    want = resolved_in_time(a, b).where("status <> 'auto_skipped'")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 0
