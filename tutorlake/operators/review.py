"""The review queue: which results a person looks at, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorlake.functions.text import strip

# Confidence below which a person is asked.
OCR, ASR, PARSER, VERIFIER, EDGE = 0.70, 0.65, 0.60, 0.70, 0.85
TIMEOUT_SECONDS = 300


def _route(trigger: Column, reason: Column) -> Column:
    return F.when(trigger.isNotNull(), F.struct(trigger.alias("trigger"), reason.alias("reason")))


def _percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100).cast("int").cast("string"), F.lit("%"))


def route_extractions(df: DataFrame) -> DataFrame:
    """``df`` (input_type, extracted_text, confidence, error) with ``review``: null if none is needed."""
    text, kind, conf = F.coalesce("extracted_text", F.lit("")), F.col("input_type"), F.col("confidence")
    failed = (F.coalesce("error", F.lit("")) != "") | (F.length(strip(text)) < 3)
    limit = F.when(kind == "image", OCR).otherwise(ASR)
    trigger = F.when(kind == "text", None).when(failed, "extraction_failed").when(conf < limit, F.when(kind == "image", "ocr_low_confidence").otherwise("asr_low_confidence"))
    reason = F.when(failed, F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("failed: "), F.col("error"))).otherwise(F.lit("empty or very short"))).otherwise(F.concat(_percent(conf), F.lit(" is below "), _percent(limit)))
    return df.withColumn("review", _route(trigger, reason)).withColumn("review_confidence", F.when(failed, 0.0).otherwise(conf))


def _list(label: str, c: str, n: int) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, n), ", ")))


def route_parses(df: DataFrame) -> DataFrame:
    """needs_clarification, missing_info, ambiguities, confidence, in this order."""
    conf, missing, vague = F.col("confidence"), F.size("missing_info") > 0, F.size("ambiguities") > 0
    trigger = F.when(F.col("needs_clarification"), "parser_ambiguity").when(missing, "parser_missing_info").when(vague, "parser_ambiguity").when(conf < PARSER, "parser_low_confidence")
    parts = F.array_compact(F.array(F.nullif("clarification_reason", F.lit("")), _list("ambiguous: ", "ambiguities", 3), _list("missing: ", "missing_info", 3), F.when(conf < PARSER, F.concat(F.lit("low confidence "), _percent(conf)))))
    return df.withColumn("review", _route(trigger, F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("needs clarification")))


def route_verifications(df: DataFrame) -> DataFrame:
    """Wrong or failed checks, issues, low confidence, edge cases with middling confidence."""
    conf = F.col("confidence")
    trigger = (
        F.when(~F.col("is_correct") | (F.size("checks_failed") > 0), "verifier_incorrect")
        .when((F.size("issues") > 0) | (conf < VERIFIER), "verifier_low_confidence")
        .when((F.size("edge_cases") > 0) & (conf < EDGE), "verifier_edge_case")
    )
    parts = F.array_compact(
        F.array(F.when(~F.col("is_correct"), F.lit("errors in the solution")), _list("failed: ", "checks_failed", 3), _list("issues: ", "issues", 3), F.when(conf < VERIFIER, F.concat(F.lit("low confidence "), _percent(conf))), _list("edge cases: ", "edge_cases", 2))
    )
    return df.withColumn("review", _route(trigger, F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("uncertain")))


def route_warnings(screened: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Rows whose screening ended in a warning; confidence 0.5 where none is known."""
    rows = screened.where((F.col("status") == "warning") & (F.size("warnings") > 0))
    return rows.withColumn("reason", F.array_join(F.slice("warnings", 1, 3), "; ")).withColumn("review_confidence", F.coalesce(confidence, F.lit(0.5)) if confidence is not None else F.lit(0.5))


def resolve(requests: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(request_id, action, trigger, stage, input_type, original, final, correction): final content
    is what the person gave, else what was suggested; an edit that changed something is a correction."""
    both = requests.join(resolutions, "request_id")
    final = F.coalesce(F.nullif("final_content", F.lit("")), F.col("suggested_content"))
    edited = (F.col("action") == "edited") & (final != F.col("original_content"))
    return both.select("request_id", "action", "trigger", "stage", "input_type", F.col("original_content").alias("original"), final.alias("final"), F.when(edited, F.create_map(F.col("original_content"), final)).alias("correction"))


def pending(requests: DataFrame, resolutions: DataFrame) -> DataFrame:
    return requests.join(resolutions.select("request_id"), "request_id", "left_anti")


def review_stats(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """(metric, name, value): totals, counts by action, trigger and stage, and rates."""
    sets = resolved.groupingSets([["action"], ["trigger"], ["stage"], []], "action", "trigger", "stage").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    metric = F.when(F.col("g") == 3, "action").when(F.col("g") == 5, "trigger").when(F.col("g") == 6, "stage").otherwise("total")
    rows = sets.select(metric.alias("metric"), F.coalesce("action", "trigger", "stage", F.lit("")).alias("name"), F.col("n").cast("double").alias("value"))
    waiting = pending(requests, resolved).agg(F.count("*").cast("double").alias("value")).select(F.lit("pending").alias("metric"), F.lit("").alias("name"), "value")
    rate = lambda a: F.coalesce(F.avg((F.col("action") == a).cast("double")), F.lit(0.0))
    rates = resolved.agg(F.create_map(*(x for a in ("edited", "approved", "rejected") for x in (F.lit(a), rate(a)))).alias("m")).select(F.lit("rate").alias("metric"), F.explode("m").alias("name", "value"))
    return rows.unionByName(waiting).unionByName(rates)


def learning_signals(resolved: DataFrame, n: int = 500) -> DataFrame:
    """(request_id, original, corrected, learn): first n characters; ``learn`` marks edits of what
    was read from an image or heard, the input of the correction counts."""
    learn = (F.col("action") == "edited") & (F.col("stage") == "extraction") & F.col("input_type").isin("image", "audio")
    return resolved.select("request_id", "input_type", F.substring("original", 1, n).alias("original_text"), F.substring("final", 1, n).alias("corrected_text"), learn.alias("learn"))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "High").when(confidence >= 0.5, "Medium").otherwise("Low")


def title(trigger: Column) -> Column:
    return F.initcap(F.replace(trigger, F.lit("_"), F.lit(" ")))


def resolved_in_time(requests: DataFrame, resolutions: DataFrame, seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """(request_id, status): a resolution within ``seconds`` of the request, else 'auto_skipped'.
    The twin of the streaming join in ``streaming.jobs``."""
    a, b = requests.select("request_id", "created_at").alias("a"), resolutions.select("request_id", "action", "resolved_at").alias("b")
    in_time = (F.col("a.request_id") == F.col("b.request_id")) & F.col("b.resolved_at").between(F.col("a.created_at"), F.col("a.created_at") + F.expr(f"interval {seconds} seconds"))
    return a.join(b, in_time, "left").select("a.request_id", F.coalesce("b.action", F.lit("auto_skipped")).alias("status"))
