"""Screening of question and answer texts (input and output checks) as column expressions.

Everything here is a narrow stage over one text column: no shuffle. Null texts count as empty.
Patterns and limits are in ``rules``. One automaton over what the patterns must hold is run once a
text (``literals``); its bits, the parameter ``seen`` of the checks, tell which of the patterns, all
of them expressions, need to be tried. Known differences from the rules as first
written: patterns that could never match are left out, and two lookaheads that decide nothing
once a word has to end are too.
"""

from __future__ import annotations

import re
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorlake.functions import rules as R
from tutorlake.functions.prefilter import Literals
from tutorlake.functions.text import Gate, chain, contains_any, count_hits, first_label, has, may_any, once, rx, strip

_REPEATS = [(re.escape(m) + "{3,}", ("\\$" if m == "$" else m) * 2) for m in R.REPEATED]
_EXPRESSIONS = [(r"\d+\s*[+\-*/^]\s*\d+", 1.5), (r"[a-z]\s*[+\-*/^=]\s*\d", 1.5), (r"[a-z]\s*\^\s*\d", 1.0)]
_NUMBER, _INTEGER = r"\b\d+(?:\.\d+)?\b", r"\b\d+\b"
_LITERALS = Literals(
    [p for rules in (R.DANGEROUS, R.INJECTION, R.CONTENT_INJECTION, R.HARM, R.PII, R.OFF_TOPIC, R.SMALL_TALK, R.PRE, _REPEATS, _EXPRESSIONS, *(s for _, s in R.STAGES)) for p, *_ in rules]
    + [p for rules in (R.PROFANITY, R.QUICK_MATH, R.MATH_WORDS, R.WORD_PROBLEM, R.STRUCTURE, R.BOOST_STRONG, R.BOOST_WORDS, R.CITED, R.REFUSAL) for p in rules]
    + [_NUMBER, _INTEGER]
)


def literals(text: Column) -> Column:
    """What a text has of the strings that patterns need, for the parameter ``seen`` of the checks."""
    return _LITERALS.bits(text)


def _gate(text: Column, seen: Column | None) -> Gate:
    return partial(_LITERALS.may, literals(text) if seen is None else seen)


def _lower(text: Column, low: Column | None) -> Column:
    """The text in lower case: ``low`` where the caller has it as a column already."""
    return F.lower(text) if low is None else low


def sanitize(text: Column, most: int = R.MAX_LENGTH) -> Column:
    """White space and control characters tidied, cut to ``most`` characters, stripped."""
    return strip(F.substring(chain(F.coalesce(text, F.lit("")), R.SANITIZE), 1, most))


def _tidy(text: Column, gate: Gate) -> Column:
    """Three or more of a mark become two, three or more spaces become two; stripped."""
    fewer = chain(text, _REPEATS)
    fewer = F.when(may_any([p for p, _ in _REPEATS], gate), fewer).otherwise(text)
    return strip(F.regexp_replace(fewer, rx(r"\s{3,}"), "  "))


def deep_sanitize(df: DataFrame, text: str = "text", seen: str | None = None) -> DataFrame:
    """``df`` with ``clean`` and ``threats``: dangerous parts taken out stage by stage, with the
    label of each stage that took something. ``seen`` names a column for what ``clean`` may hold."""
    first = F.coalesce(F.col(text), F.lit(""))
    df = once(df, __seen=literals(first))
    labels, now = [], first
    for i, (label, steps) in enumerate(R.STAGES):
        # what a stage takes out can bring together what a later one looks for
        may = may_any([p for p, _ in steps], partial(_LITERALS.may, F.col("__seen"))) | (now != first)
        df = df.withColumn(f"__s{i}", F.when(may, chain(now, steps)).otherwise(now))
        labels.append(F.when(F.col(f"__s{i}") != now, F.lit(label)))
        now = F.col(f"__s{i}")
    df = df.withColumn("__open", F.when(now != first, _LITERALS.every()).otherwise(F.col("__seen")))
    columns = {"clean": _tidy(now, partial(_LITERALS.may, F.col("__open"))), "threats": F.array_compact(F.array(*labels))}
    if seen is not None:
        columns[seen] = F.col("__open")
    return once(df, **columns).drop("__seen", "__open", *(f"__s{i}" for i in range(len(R.STAGES))))


def pre_sanitize(text: Column) -> Column:
    """The shorter list of removals that runs before everything else."""
    text = F.coalesce(text, F.lit(""))
    gate = _gate(text, None)
    taken = F.when(may_any([p for p, _ in R.PRE], gate), _tidy(chain(text, R.PRE), lambda p: None))
    return F.coalesce(taken, _tidy(text, gate))


def length_check(text: Column, least: int = R.MIN_LENGTH, most: int = R.MAX_LENGTH) -> Column:
    """'empty', 'short', 'long' or 'ok'."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(strip(text))
    return F.when(text == "", "empty").when(n < least, "short").when(n > most, "long").otherwise("ok")


def dangerous_label(text: Column, low: Column | None = None, seen: Column | None = None) -> Column:
    return first_label(_lower(text, low), R.DANGEROUS, _gate(text, seen))


def injections(text: Column, seen: Column | None = None) -> Column:
    """array<struct<category, severity>> of all injection patterns that occur."""
    low, gate = F.lower(text), _gate(text, seen)
    return F.array_compact(F.array(*(F.when(has(low, p, gate), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"))) for p, c, s in R.INJECTION)))


def injection_check(text: Column, strict: bool = False, low: Column | None = None, seen: Column | None = None) -> Column:
    """'dangerous' and 'blocked' stop a text, 'warning' lets it pass, 'ok' found nothing."""
    low, gate = _lower(text, low), _gate(text, seen)
    high, other = (reduce(Column.__or__, (has(low, p, gate) for p, _, s in R.INJECTION if (s == "high") == want)) for want in (True, False))
    return F.when(dangerous_label(text, low, seen).isNotNull(), "dangerous").when(high, "blocked").when(other, "blocked" if strict else "warning").otherwise("ok")


def math_indicators(text: Column, seen: Column | None = None) -> Column:
    return count_hits(F.lower(text), R.QUICK_MATH, _gate(text, seen))


def content_injection_label(text: Column, low: Column | None = None, seen: Column | None = None) -> Column:
    return first_label(_lower(text, low), R.CONTENT_INJECTION, _gate(text, seen))


def harm_label(text: Column, low: Column | None = None, seen: Column | None = None) -> Column:
    return first_label(_lower(text, low), R.HARM, _gate(text, seen))


def has_profanity(text: Column, low: Column | None = None, seen: Column | None = None) -> Column:
    low, gate = _lower(text, low), _gate(text, seen)
    return reduce(Column.__or__, (has(low, p, gate) for p in R.PROFANITY))


def pii_label(text: Column, seen: Column | None = None) -> Column:
    return first_label(text, R.PII, _gate(text, seen))


def math_score(text: Column, low: Column | None = None, seen: Column | None = None) -> Column:
    """0 to 1: keywords up to 3 points, numbers 1, expressions 1.5 + 1.5 + 1, word problems 2, of 10."""
    low, gate = _lower(text, low), _gate(text, seen)
    numbers = F.when(gate(_NUMBER), F.size(F.regexp_extract_all(text, F.lit(rx(_NUMBER)), 0))).otherwise(0)
    points = F.least(count_hits(low, R.MATH_WORDS, gate) * 0.5, F.lit(3.0)) + F.least(numbers * 0.2, F.lit(1.0))
    for pattern, gain in _EXPRESSIONS:
        points = points + F.when(has(low, pattern, gate), gain).otherwise(0.0)
    points = points + F.least(count_hits(low, R.WORD_PROBLEM, gate) * 0.4, F.lit(2.0))
    return F.least(points / 10, F.lit(1.0))


def is_word_problem(text: Column, seen: Column | None = None) -> Column:
    low, gate = F.lower(text), _gate(text, seen)
    return has(text, _INTEGER, gate) & reduce(Column.__or__, (has(low, p, gate) for p in R.WORD_PROBLEM + R.STRUCTURE))


def off_topic_label(text: Column, seen: Column | None = None) -> Column:
    low, gate = F.lower(text), _gate(text, seen)
    off, small = first_label(low, R.OFF_TOPIC, gate), first_label(low, R.SMALL_TALK, gate)
    score = math_score(text, low, seen)  # only of the few texts that begin in such a way
    return F.when(off.isNotNull() & (score < 0.3), off).when(off.isNull() & small.isNotNull() & (score < 0.1), small)


def rule_boost(text: Column, seen: Column | None = None) -> Column:
    gate = _gate(text, seen)
    return F.least(count_hits(text, R.BOOST_STRONG, gate) * 0.12 + count_hits(F.lower(text), R.BOOST_WORDS, gate) * 0.08, F.lit(0.35))


def content_verdict(text: Column, is_math: Column, confidence: Column, topic: Column, low: Column | None = None, seen: Column | None = None) -> Column:
    """struct<level, category, confidence>, first rule that holds: empty, injection, harm,
    profanity, personal data (a warning that skips the topic test), not mathematical, safe."""
    text = strip(F.coalesce(text, F.lit("")))
    low = _lower(text, low)

    def of(level, category, conf=1.0):
        return F.struct(F.lit(level).alias("level"), (category if isinstance(category, Column) else F.lit(category)).alias("category"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("confidence"))

    return (
        F.when(text == "", of("blocked", "empty"))
        .when(content_injection_label(text, low, seen).isNotNull(), of("blocked", "injection"))
        .when(harm_label(text, low, seen).isNotNull(), of("blocked", "harmful"))
        .when(has_profanity(text, low, seen), of("blocked", "profanity"))
        .when(pii_label(text, seen).isNotNull(), of("warning", "pii"))
        .when(~is_math & (confidence < 0.3), of("blocked", "off_topic", confidence))
        .when(~is_math, of("warning", "low_confidence", confidence))
        .otherwise(of("safe", topic, confidence))
    )


def screen_inputs(df: DataFrame, text: str = "text", strict: bool = False, is_math: Column | None = None, confidence: Column | None = None, topic: Column | None = None) -> DataFrame:
    """``df`` with clean, threats, status (passed, warning, blocked), category and warnings.

    Without the columns of a classifier the maths score stands in: mathematical from 0.3 on.
    """
    df = deep_sanitize(once(df, __basic=sanitize(F.col(text))), "__basic", "__seen_clean").drop("__basic")
    clean, low, seen = F.col("clean"), F.col("__low"), F.col("__seen_clean")
    df = once(df, __low=F.lower(clean))
    df = once(df, __score=math_score(clean, low, seen), __injection=injection_check(clean, strict, low, seen), __length=length_check(clean))
    score = F.col("__score")
    df = once(df, __verdict=content_verdict(clean, is_math if is_math is not None else score >= 0.3, confidence if confidence is not None else score, topic if topic is not None else F.lit("general"), low, seen))
    threats = F.size("threats") > 0
    stopped = F.col("__injection").isin("dangerous", "blocked")
    stop = (
        F.when(clean == "", "nothing_left")
        .when(F.col("__length") != "ok", F.col("__length"))
        .when(stopped & (threats | F.lit(strict)), "injection")
        .when(F.col("__verdict.level") == "blocked", F.col("__verdict.category"))
    )
    warnings = F.array_compact(
        F.array(
            F.when(threats, F.concat(F.lit("removed: "), F.array_join("threats", ", "))),
            F.when(stopped, F.lit("like an injection")),
            F.when(F.col("__injection") == "warning", F.lit("unusual patterns")),
            F.when(F.col("__verdict.level") == "warning", F.col("__verdict.category")),
        )
    )
    none = F.array().cast("array<string>")
    df = df.withColumn("__stop", stop).withColumn("warnings", F.when(F.col("__stop").isNull(), warnings).otherwise(none))
    status = F.when(F.col("__stop").isNotNull(), "blocked").when(F.size("warnings") > 0, "warning").otherwise("passed")
    df = df.withColumn("status", status).withColumn("category", F.coalesce("__stop", F.col("__verdict.category")))
    return df.drop("__low", "__seen_clean", "__score", "__injection", "__length", "__verdict", "__stop")


#: What a rejected text is told, by category (our own words), and what it might try.
MESSAGES = {"nothing_left": "Nothing was left after filtering.", "empty": "Please enter a question.", "short": "The question is too short.", "long": "The question is too long.", "injection": "The input has an invalid format.", "harmful": "This content is not allowed.", "profanity": "Please use other words.", "off_topic": "This is no maths question."}
TIPS = {"nothing_left": ["Enter a maths question", "Leave out code"], "short": ["Enter a whole question"], "long": ["Shorten the question"], "injection": ["Enter a maths question"]}


def rejection(category: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, category), F.lit("The input could not be processed."))


def suggestions(category: Column, more: Column | None = None) -> Column:
    """Tips of the category, then others, each once in this order."""
    tips = F.coalesce(*(F.when(category == k, F.array(*map(F.lit, v))) for k, v in TIPS.items()), F.array(F.lit("Enter a maths question")))
    return F.array_distinct(F.concat(tips, more) if more is not None else tips)


#: Display labels of topics (fixed values).
TOPIC_LABELS = {"algebra": "Algebra", "calculus": "Calculus", "probability": "Probability", "statistics": "Statistics", "trigonometry": "Trigonometry", "vectors": "Vectors", "coordinate_geometry": "Coordinate Geometry", "linear_algebra": "Linear Algebra", "general": "General"}


def topic_label(topic: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TOPIC_LABELS.items() for x in kv)), topic), topic)


def validate_outputs(df: DataFrame, solution: str = "solution", verification: str = "verification", explanation: str = "explanation") -> DataFrame:
    """``df`` with errors, warnings, output_confidence, is_valid and cleaned texts."""
    sol, ver, exp = (F.coalesce(F.col(c), F.lit("")) for c in (solution, verification, explanation))
    full = F.concat_ws(" ", sol, ver, exp)
    gate = _gate(full, None)
    cited = count_hits(full, R.CITED, gate)
    rules = [(p, "") for p in R.CITED]
    fixed = lambda c: F.when(cited > 0, strip(chain(c, rules))).otherwise(c)
    df = df.withColumn("clean_solution", fixed(sol)).withColumn("clean_explanation", fixed(exp))
    done = F.col("clean_solution")
    low = F.lower(done)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    whole = (done != "") & ~(F.endswith(done, F.lit("...")) & (F.length(done) > 100)) & (count(done, "(") == count(done, ")")) & (count(done, "[") == count(done, "]")) & (F.length(done) > 20)
    short, refused, bad = F.length(strip(sol)) < 10, reduce(Column.__or__, (has(full, p, gate) for p in R.REFUSAL)), contains_any(F.lower(full), R.INAPPROPRIATE)
    parts = contains_any(low, R.COMPONENTS)
    points = 1.0 - F.when(short, 0.5).otherwise(0.0) - cited * 0.1 - F.when(refused, 0.3).otherwise(0.0) - F.when(parts, 0.0).otherwise(0.1)
    points = F.when(bad, 0.0).otherwise(points) - F.when(whole, 0.0).otherwise(0.2)
    df = df.withColumn("errors", F.array_compact(F.array(F.when(short, F.lit("short")), F.when(refused, F.lit("refusal")), F.when(bad, F.lit("inappropriate")))))
    df = df.withColumn("output_warnings", F.concat(F.array_repeat(F.lit("citation"), cited), F.array_compact(F.array(F.when(~parts, F.lit("incomplete")), F.when(~whole, F.lit("truncated"))))))
    return df.withColumn("output_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), points))).withColumn("is_valid", F.size("errors") == 0)


def screen_outputs(df: DataFrame, solution: str = "solution", verification: str = "verification", explanation: str = "explanation") -> DataFrame:
    """``df`` with output_status and output_reason: profanity and harm block, then errors block
    with their list, warnings warn."""
    df = validate_outputs(df, solution, verification, explanation)
    full = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in (solution, verification, explanation)))
    reason = F.when(has_profanity(full), "profanity").when(harm_label(full).isNotNull(), "harmful").when(F.size("errors") > 0, F.array_join("errors", "; "))
    df = df.withColumn("output_reason", reason)
    return df.withColumn("output_status", F.when(F.col("output_reason").isNotNull(), "blocked").when(F.size("output_warnings") > 0, "warning").otherwise("passed"))


def screen_pipeline(df: DataFrame, question: str = "question", solution: str = "solution", verification: str = "verification", explanation: str = "explanation") -> DataFrame:
    """Input and output in one narrow stage; the output is only judged where the input passed."""
    df = screen_outputs(screen_inputs(df, question), solution, verification, explanation)
    return df.withColumn("output_status", F.when(F.col("status") != "blocked", F.col("output_status")))


def plain_display(text: Column) -> Column:
    """Without tags, white space squeezed."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""), rx(r"\s+"), " "))


def safe_display(text: Column) -> Column:
    """Script tags escaped."""
    return F.replace(F.replace(text, F.lit("<script"), F.lit("&lt;script")), F.lit("</script>"), F.lit("&lt;/script&gt;"))


