"""Streams: every function takes and returns a streaming DataFrame (or a static one, as its twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlake.functions.screening import screen_inputs
from tutorlake.operators.review import TIMEOUT_SECONDS

LATE = "1 hour"


def screen_stream(questions: DataFrame, text: str = "text") -> DataFrame:
    """Stateless: each question with its screening."""
    return screen_inputs(questions, text)


def accuracy_windows(feedback: DataFrame, length: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Accuracy and mean score by window of ``created_at``; rows later than ``late`` are not waited for."""
    rows = feedback.withWatermark("created_at", late) if feedback.isStreaming else feedback
    got = rows.groupBy(F.window("created_at", length, slide)).agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.avg("score").alias("score"))
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "accuracy", "score")


def study_sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions of each user: activity with pauses under ``gap``."""
    rows = events.withWatermark("created_at", late) if events.isStreaming else events
    got = rows.groupBy("user_id", F.session_window("created_at", gap)).agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def correction_stream(events: DataFrame) -> DataFrame:
    """Running counts, for update or complete mode."""
    return events.where("original_text <> corrected_text").groupBy("input_type", "original_text", "corrected_text").agg(F.count("*").alias("frequency"))


def ingest_once(problems: DataFrame, late: str = LATE) -> DataFrame:
    """Each problem id once within the watermark, however often it is sent."""
    return problems.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"]) if problems.isStreaming else problems.dropDuplicates(["id"])


def reviews_in_time(requests: DataFrame, resolutions: DataFrame, seconds: int = TIMEOUT_SECONDS, late: str = LATE) -> DataFrame:
    """Requests with the resolution that came within ``seconds``, else 'auto_skipped' once the
    watermark has passed. State is bounded by the watermarks and the interval."""
    a = requests.select("request_id", "created_at").withWatermark("created_at", late).alias("a")
    b = resolutions.select(F.col("request_id").alias("r"), "action", "resolved_at").withWatermark("resolved_at", late).alias("b")
    near = (F.col("request_id") == F.col("r")) & (F.col("resolved_at") >= F.col("created_at")) & (F.col("resolved_at") <= F.col("created_at") + F.expr(f"interval {seconds} seconds"))
    return a.join(b, near, "left").select("request_id", F.coalesce("action", F.lit("auto_skipped")).alias("status"))
