"""Queries of the screening operators (G1 to G22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorlake.functions import rules as R
from tutorlake.functions import screening as S
from tutorlake.functions.text import once
from tutorlake.plans import duck as D
from tutorlake.plans.inputs import ASKED, PROBLEMS, phrases, problems, texts



def _by_text(rows=phrases, **columns):
    return lambda spark, sf: rows(spark, sf).select("doc_id", *(f(F.col("text")).alias(k) for k, f in columns.items()))


def _sql(**columns: str) -> str:
    return f"WITH {ASKED} SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM asked"


def _join(labels):
    return F.array_join(labels, ",")


def _tidy(text: str) -> str:
    for m in R.REPEATED:
        esc = "\\" + m if m in "?$^*|" else m
        text = f"regexp_replace({text}, {D.q(esc + '{3,}')}, {D.q(m * 2)}, 'g')"
    return D.strip(f"regexp_replace({text}, '\\s{{3,}}', '  ', 'g')")


SANITIZED = D.strip(f"substr({D.chain('text', R.SANITIZE)}, 1, {R.MAX_LENGTH})")


def _stages(source: str) -> str:
    ctes, prev, labels = [], "text", []
    for i, (label, steps) in enumerate(R.STAGES):
        ctes.append(f"d{i} AS (SELECT *, {D.chain(prev, steps)} AS s{i} FROM {'d' + str(i - 1) if i else source})")
        labels.append(f"CASE WHEN s{i} <> {prev} THEN {D.q(label)} END")
        prev = f"s{i}"
    last = f"d{len(R.STAGES) - 1}"
    return ", ".join(ctes) + f", deep AS (SELECT *, {_tidy(prev)} AS clean, list_filter([{', '.join(labels)}], lambda x: x IS NOT NULL) AS threats FROM {last})"


LENGTH = "CASE WHEN text = '' THEN 'empty' WHEN length(" + D.strip("text") + f") < {R.MIN_LENGTH} THEN 'short' WHEN length(" + D.strip("text") + f") > {R.MAX_LENGTH} THEN 'long' ELSE 'ok' END"
LOW = "lower(text)"

def _ascii_words(sql: str) -> str:
    """The oracle's word borders know ASCII only: accented letters become another word character."""
    accented = "[\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]"
    return sql.removesuffix("FROM asked") + f"FROM (SELECT doc_id, regexp_replace(text, '{accented}', '_', 'g') AS text FROM asked)"


SCORE = (
    f"least((least({D.count_hits(LOW, R.MATH_WORDS)} * 0.5::DOUBLE, 3.0::DOUBLE) + least(len(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\b')) * 0.2::DOUBLE, 1.0::DOUBLE)"
    f" + CASE WHEN {D.has(LOW, r'[0-9]+\s*[+\-*/^]\s*[0-9]+')} THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN {D.has(LOW, r'[a-z]\s*[+\-*/^=]\s*[0-9]')} THEN 1.5::DOUBLE ELSE 0 END"
    f" + CASE WHEN {D.has(LOW, r'[a-z]\s*\^\s*[0-9]')} THEN 1.0::DOUBLE ELSE 0 END + least({D.count_hits(LOW, R.WORD_PROBLEM)} * 0.4::DOUBLE, 2.0::DOUBLE)) / 10, 1.0::DOUBLE)"
)
BOOST = f"least({D.count_hits('text', R.BOOST_STRONG)} * 0.12::DOUBLE + {D.count_hits(LOW, R.BOOST_WORDS)} * 0.08::DOUBLE, 0.35::DOUBLE)"
FULL = "(question || ' ' || coalesce(solution, '') || ' ')"
CLEANED = "CASE WHEN cited > 0 THEN " + D.strip(D.chain("solution", [(p, "") for p in R.CITED])) + " ELSE solution END"
WHOLE = (
    "clean_solution <> '' AND NOT (suffix(clean_solution, '...') AND length(clean_solution) > 100)"
    " AND length(replace(clean_solution, '(', '')) = length(replace(clean_solution, ')', '')) AND length(replace(clean_solution, '[', '')) = length(replace(clean_solution, ']', '')) AND length(clean_solution) > 20"
)
OUTPUTS = f"""{PROBLEMS}, o1 AS (
    SELECT id, coalesce(solution, '') AS solution, coalesce(question, '') AS explanation, coalesce(solution, '') || '  ' || coalesce(question, '') AS whole_text FROM problems
), o2 AS (SELECT *, {D.count_hits('whole_text', R.CITED)} AS cited FROM o1
), o3 AS (SELECT *, {CLEANED} AS clean_solution FROM o2
), o4 AS (SELECT *, {WHOLE} AS is_whole, {D.contains_any('lower(clean_solution)', R.COMPONENTS)} AS has_parts, length({D.strip('solution')}) < 10 AS is_short,
                 {D.has('whole_text', '|'.join(R.REFUSAL))} AS refused, {D.contains_any('lower(whole_text)', R.INAPPROPRIATE)} AS bad FROM o3
), o5 AS (SELECT *, greatest(0, least(1, CASE WHEN bad THEN 0 ELSE 1 - CASE WHEN is_short THEN 0.5 ELSE 0 END - cited * 0.1 - CASE WHEN refused THEN 0.3 ELSE 0 END - CASE WHEN has_parts THEN 0 ELSE 0.1 END END
                 - CASE WHEN is_whole THEN 0 ELSE 0.2 END)) AS conf,
                 array_to_string(list_filter([CASE WHEN is_short THEN 'short' END, CASE WHEN refused THEN 'refusal' END, CASE WHEN bad THEN 'inappropriate' END], lambda x: x IS NOT NULL), '; ') AS errors FROM o4)"""
OUT_REASON = f"CASE WHEN {D.has('lower(whole_text)', '|'.join(R.PROFANITY))} THEN 'profanity' WHEN {D.first_label('lower(whole_text)', R.HARM)} IS NOT NULL THEN 'harmful' WHEN errors <> '' THEN errors END"


def _outputs(spark, sf):
    return problems(spark, sf).select("id", "solution", F.lit("").alias("verification"), F.col("question").alias("explanation"))


def g2(spark, sf):
    got = S.deep_sanitize(phrases(spark, sf))
    return got.select("doc_id", "clean", _join("threats").alias("threats"))


def g15(spark, sf):
    rows = once(texts(spark, sf), low=F.lower("text"))
    # what a text has, the text without white space at its ends has no more of: one pass tells for both
    rows = once(rows, seen=S.literals(F.col("text")))
    text, low, seen, score = F.col("text"), F.col("low"), F.col("seen"), F.col("score")
    rows = once(rows, score=S.math_score(text, low, seen))
    got = once(rows, v=S.content_verdict(text, score >= 0.3, score, F.lit("general"), low, seen))
    return got.select("doc_id", "v.level", "v.category", F.round("v.confidence", 6).alias("confidence"))


def g16(spark, sf):
    got = S.screen_inputs(texts(spark, sf))
    return got.select("doc_id", "status", "category", _join("warnings").alias("warnings"))


def g17(spark, sf):
    got = S.screen_inputs(texts(spark, sf)).where("status = 'blocked'")
    return got.select("doc_id", S.rejection(F.col("category")).alias("message"), _join(S.suggestions(F.col("category"))).alias("suggestions"))


def g19(spark, sf):
    got = S.validate_outputs(_outputs(spark, sf))
    return got.select("id", F.array_join("errors", "; ").alias("errors"), F.round("output_confidence", 6).alias("confidence"), "is_valid", F.md5("clean_solution").alias("clean"))


def g20(spark, sf):
    return S.screen_outputs(_outputs(spark, sf)).select("id", "output_status", "output_reason")


def g21(spark, sf):
    rows = problems(spark, sf).select("id", "question", "solution", F.lit("").alias("verification"), F.lit("").alias("explanation"))
    return S.screen_pipeline(rows).select("id", "status", "output_status")


QUERIES = {
    "g1_sanitize": _by_text(clean=S.sanitize),
    "g2_deep_sanitize": g2,
    "g3_pre_sanitize": _by_text(clean=S.pre_sanitize),
    "g4_length": _by_text(verdict=S.length_check),
    "g5_dangerous": _by_text(label=S.dangerous_label),
    "g6_injections": _by_text(texts, labels=lambda t: _join(F.transform(S.injections(t), lambda x: x["category"]))),
    "g7_injection_check": _by_text(texts, verdict=S.injection_check, strict=lambda t: S.injection_check(t, True)),
    "g8_math_indicators": _by_text(n=S.math_indicators),
    "g9_content_labels": _by_text(harm=S.harm_label, profane=S.has_profanity, pii=S.pii_label),
    "g9_content_injection": _by_text(texts, injected=S.content_injection_label),
    "g10_math_score": _by_text(score=lambda t: F.round(S.math_score(t), 6)),
    "g11_word_problem": _by_text(is_word_problem=S.is_word_problem),
    "g12_off_topic": _by_text(texts, label=S.off_topic_label),
    "g14_rule_boost": _by_text(boost=lambda t: F.round(S.rule_boost(t), 6)),
    "g15_content_verdict": g15,
    "g16_screen_inputs": g16,
    "g17_rejections": g17,
    "g18_topic_label": lambda spark, sf: problems(spark, sf).select("id", S.topic_label(F.col("topic")).alias("label")),
    "g19_validate_outputs": g19,
    "g20_screen_outputs": g20,
    "g21_screen_pipeline": g21,
    "g22_display": lambda spark, sf: spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.md5(S.plain_display(F.col("html"))).alias("plain"), F.md5(S.safe_display(F.col("html"))).alias("safe")),
}

ORACLE_SQL = {
    "g1_sanitize": _sql(clean=SANITIZED),
    "g2_deep_sanitize": f"WITH {ASKED}, {_stages('asked')} SELECT doc_id, clean, array_to_string(threats, ',') AS threats FROM deep",
    "g3_pre_sanitize": _sql(clean=_tidy(D.chain("text", R.PRE))),
    "g4_length": _sql(verdict=LENGTH),
    "g5_dangerous": _sql(label=D.first_label(LOW, R.DANGEROUS)),
    "g8_math_indicators": _sql(n=D.count_hits(LOW, R.QUICK_MATH)),
    "g9_content_labels": _sql(harm=D.first_label(LOW, R.HARM), profane=D.has(LOW, "|".join(R.PROFANITY)), pii=D.first_label("text", R.PII)),
    "g10_math_score": _ascii_words(_sql(score=f"round({SCORE}, 6)")),
    "g11_word_problem": _sql(is_word_problem=f"({D.has('text', r'[0-9]')} AND {D.has('text', r'\b\d+\b')} AND {D.has(LOW, '|'.join(R.WORD_PROBLEM + R.STRUCTURE))})"),
    "g14_rule_boost": _sql(boost=f"round({BOOST}, 6)"),
    "g18_topic_label": f"WITH {PROBLEMS} SELECT id, CASE topic " + " ".join(f"WHEN {D.q(k)} THEN {D.q(v)}" for k, v in S.TOPIC_LABELS.items()) + " ELSE topic END AS label FROM problems",
    "g19_validate_outputs": f"WITH {OUTPUTS} SELECT id, errors, round(conf, 6) AS confidence, errors = '' AS is_valid, md5(clean_solution) AS clean FROM o5",
    "g20_screen_outputs": f"WITH {OUTPUTS}, o6 AS (SELECT *, {OUT_REASON} AS output_reason FROM o5) SELECT id, CASE WHEN output_reason IS NOT NULL THEN 'blocked' WHEN cited > 0 OR NOT has_parts OR NOT is_whole THEN 'warning' ELSE 'passed' END AS output_status, output_reason FROM o6",
    "g22_display": "SELECT page_id, md5(" + D.squeeze("regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')") + ") AS plain, md5(replace(replace(html, '<script', '&lt;script'), '</script>', '&lt;/script&gt;')) AS safe FROM pages",
}
