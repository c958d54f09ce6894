"""Queries of evaluation (V1 to V12) and of the review queue (H1 to H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorlake.functions import screening as S
from tutorlake.functions.text import words
from tutorlake.operators import evaluation as V
from tutorlake.operators import memory as M
from tutorlake.operators import review as H
from tutorlake.operators import search as R
from tutorlake.plans import duck as D
from tutorlake.plans.inputs import FEEDBACK, PROBLEMS, corrections, feedback, problems, table, texts
from tutorlake.plans.q_memory import COUNTS
from tutorlake.plans.q_search import BM25, _keyword

W = lambda t: f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"


def cases(s, d):
    """Test cases: benchmark items, the first word as keyword and accepted answer."""
    b = table(s, d, "benchmark")
    first = F.get(words(F.lower("text")), F.lit(0))
    topics = F.array(F.lit("algebra"), F.lit("calculus"), F.lit("statistics"))
    return b.select(F.col("item_id").alias("case_id"), F.element_at(topics, (F.col("item_id") % 3 + 1).cast("int")).alias("topic"), (F.col("item_id") % 4 + 1).cast("int").alias("difficulty"), F.array(F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")).alias("tags"), F.array(first).alias("keywords"), F.array(first, F.lit("42")).alias("accepted"), F.col("text").alias("answer"))


CASES = f"""cases AS (SELECT item_id AS case_id, ['algebra', 'calculus', 'statistics'][item_id % 3 + 1] AS topic, item_id % 4 + 1 AS difficulty,
    CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS tag, {W('lower(text)')}[1] AS word, text AS answer FROM benchmark)"""


def hits(s, d):
    """The ten best documents of each case by BM25, over all documents."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 5 == 0, "Algebra II").otherwise(F.col("lang")).alias("topic"), F.col("text").alias("content"))
    return R.few(_keyword(s, d, 10)).join(docs, "chunk_id").select(F.col("query_id").alias("case_id"), "rank", "topic", "content", "score")


HITS = f"""{BM25}, hits AS (SELECT query_id AS case_id, rank, CASE WHEN d.doc_id % 5 = 0 THEN 'Algebra II' ELSE d.lang END AS topic, d.text AS content, score
    FROM found JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 10)"""


def v2(s, d):
    got = V.eval_retrieval(cases(s, d).select("case_id", F.col("topic").alias("expected_topic"), "keywords", "answer"), hits(s, d))
    return got.select("cases", *(F.round(c, 6).alias(c) for c in got.columns if c != "cases"))


def _answers(s, d):
    return V.eval_answers(cases(s, d), hits(s, d).where("rank = 1").select("case_id", F.col("content").alias("solution")))


def v5(s, d):
    rows = table(s, d, "labels").join(S.screen_inputs(texts(s, d)).select("doc_id", "status"), "doc_id")
    got = V.eval_screening(rows.select((F.col("toxic") == 0).alias("should_pass"), (F.col("status") != "blocked").alias("passed")))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


def _metrics(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.col("event_type").alias("component"), F.concat(F.lit("user"), F.col("user_id") % 3).alias("metric")).agg(F.avg("value").alias("value"), F.lit(500.0).alias("max_value"))


METRICS = "metrics AS (SELECT event_type AS component, 'user' || (user_id % 3) AS metric, avg(value) AS value, 500.0 AS max_value FROM events GROUP BY ALL), by_c AS (SELECT component, avg(value * 100 / max_value) AS percentage FROM metrics GROUP BY component), rep AS (SELECT * FROM by_c UNION ALL SELECT 'overall', avg(percentage) FROM by_c)"
GRADE = lambda p, a=(90, 80, 70, 60): f"CASE WHEN {p} >= {a[0]} THEN 'A' WHEN {p} >= {a[1]} THEN 'B' WHEN {p} >= {a[2]} THEN 'C' WHEN {p} >= {a[3]} THEN 'D' ELSE 'F' END"


def v8(s, d):
    questions = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    got = V.rag_relevance(questions, hits(s, d).where("rank <= 5").withColumnRenamed("case_id", "query_id"))
    return got.withColumn("relevance", F.round("relevance", 6))


def _judged(s, d):
    return V.heuristic_judge(problems(s, d).withColumn("explanation", F.when(F.length("question") > 60, F.col("question"))))


def _evals(s, d):
    rows = _judged(s, d).withColumn("rag_relevance", F.col("confidence")).withColumn("n_docs", (F.length("question") % 3).cast("int"))
    return V.evaluate(rows)


LOWS = "lower(solution)"
JUDGED = f"""{PROBLEMS}, j0 AS (SELECT *, CASE WHEN length(question) > 60 THEN question END AS explanation FROM problems), judged AS (SELECT *,
    CASE WHEN {D.strip('solution')} = '' THEN 0 ELSE greatest(0, least(1, 0.5 + CASE WHEN {D.contains_any(LOWS, V.STEP_WORDS)} THEN 0.2 ELSE 0 END
      + CASE WHEN {D.contains_any(LOWS, ['final answer', 'answer:'])} THEN 0.1 ELSE 0 END + CASE WHEN length(solution) < 50 THEN -0.2 WHEN length(solution) > 200 THEN 0.1 ELSE 0 END)) END AS solution_quality,
    CASE WHEN explanation IS NULL THEN 0 WHEN length(explanation) > 100 THEN 0.7 ELSE 0.5 END AS explanation_clarity,
    concat_ws(',', CASE WHEN {D.strip('solution')} = '' THEN 'no solution' WHEN length(solution) < 50 THEN 'very short' END, CASE WHEN explanation IS NULL THEN 'no explanation' END) AS issues FROM j0)"""
EVALS = f"""{JUDGED}, e0 AS (SELECT *, 0.2 * confidence + 0.5 * solution_quality + 0.3 * explanation_clarity AS overall, length(question) % 3 AS n_docs FROM judged),
    evals AS (SELECT *, {GRADE('round(overall, 9)', (0.9, 0.8, 0.7, 0.6))} AS grade, round(overall, 9) >= 0.6 AS passed FROM e0)"""


def extractions(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("audio")), (F.col("event_id") % 3 + 1).cast("int")).alias("input_type"), F.when(F.col("user_id") % 10 == 0, "x").otherwise(F.col("event_type")).alias("extracted_text"), (F.floor(F.col("value") / 5) / 100).alias("confidence"), F.when(F.col("user_id") % 17 == 0, "codec").alias("error"))


EXTRACTIONS = "ex AS (SELECT event_id, ['text', 'image', 'audio'][event_id % 3 + 1] AS input_type, CASE WHEN user_id % 10 = 0 THEN 'x' ELSE event_type END AS extracted_text, floor(value / 5) / 100 AS confidence, CASE WHEN user_id % 17 = 0 THEN 'codec' END AS error FROM events)"


def parses(s, d):
    e = extractions(s, d)
    some = lambda cond, *v: F.when(cond, F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    i = F.col("event_id")
    return e.select("event_id", (i % 7 == 0).alias("needs_clarification"), F.when(i % 14 == 0, "unclear goal").otherwise("").alias("clarification_reason"), some(i % 5 == 0, "a", "b", "c", "d").alias("ambiguities"), some(i % 4 == 0, "units").alias("missing_info"), "confidence", (i % 9 != 0).alias("is_correct"), some(i % 11 == 0, "sign").alias("checks_failed"), some(i % 6 == 0, "rounding", "steps").alias("issues"), some(i % 2 == 0, "zero").alias("edge_cases"))


PCT = lambda c: f"CAST(round_even({c} * 100, 0) AS INT) || '%'"
PARSED = f"""{EXTRACTIONS}, pa AS (SELECT event_id, confidence,
    CASE WHEN event_id % 7 = 0 THEN 'parser_ambiguity' WHEN event_id % 4 = 0 THEN 'parser_missing_info' WHEN event_id % 5 = 0 THEN 'parser_ambiguity' WHEN confidence < 0.6 THEN 'parser_low_confidence' END AS trigger,
    concat_ws('; ', CASE WHEN event_id % 14 = 0 THEN 'unclear goal' END, CASE WHEN event_id % 5 = 0 THEN 'ambiguous: a, b, c' END, CASE WHEN event_id % 4 = 0 THEN 'missing: units' END, CASE WHEN confidence < 0.6 THEN 'low confidence ' || {PCT('confidence')} END) AS reason FROM ex)"""
VERIFIED = f"""{EXTRACTIONS}, ve AS (SELECT event_id,
    CASE WHEN event_id % 9 = 0 OR event_id % 11 = 0 THEN 'verifier_incorrect' WHEN event_id % 6 = 0 OR confidence < 0.7 THEN 'verifier_low_confidence' WHEN event_id % 2 = 0 AND confidence < 0.85 THEN 'verifier_edge_case' END AS trigger,
    concat_ws('; ', CASE WHEN event_id % 9 = 0 THEN 'errors in the solution' END, CASE WHEN event_id % 11 = 0 THEN 'failed: sign' END, CASE WHEN event_id % 6 = 0 THEN 'issues: rounding, steps' END, CASE WHEN confidence < 0.7 THEN 'low confidence ' || {PCT('confidence')} END, CASE WHEN event_id % 2 = 0 THEN 'edge cases: zero' END) AS reason FROM ex)"""


def requests(s, d):
    e = table(s, d, "events")
    i = F.col("event_id")
    return e.where(i % 2 == 0).select(i.cast("string").alias("request_id"), F.col("event_type").alias("trigger"), F.when(i % 4 == 0, "extraction").otherwise("parsing").alias("stage"), F.col("props").alias("original_content"), F.upper("event_type").alias("suggested_content"), (F.col("value") / 500).alias("confidence_score"), F.when(i % 3 == 0, "image").otherwise("text").alias("input_type"), F.col("ts").cast("timestamp").alias("created_at"))


def resolutions(s, d):
    e = table(s, d, "events")
    i = F.col("event_id")
    actions = F.array(F.lit("approved"), F.lit("edited"), F.lit("rejected"))
    return e.where(i % 5 != 0).select(i.cast("string").alias("request_id"), F.element_at(actions, (F.col("user_id") % 3 + 1).cast("int")).alias("action"), F.when(F.col("user_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("final_content"), (F.col("ts").cast("timestamp") + F.make_interval(secs=(i % 500).cast("decimal(18,6)"))).alias("resolved_at"))


REVIEWS = """requests AS (SELECT event_id::VARCHAR AS request_id, event_type AS trigger, CASE WHEN event_id % 4 = 0 THEN 'extraction' ELSE 'parsing' END AS stage, props AS original_content, upper(event_type) AS suggested_content,
        CASE WHEN event_id % 3 = 0 THEN 'image' ELSE 'text' END AS input_type, ts AS created_at, event_id FROM events WHERE event_id % 2 = 0),
    resolutions AS (SELECT event_id::VARCHAR AS request_id, ['approved', 'edited', 'rejected'][user_id % 3 + 1] AS action, CASE WHEN user_id % 4 = 0 THEN '' ELSE event_type END AS final_content, ts + to_seconds(event_id % 500) AS resolved_at FROM events WHERE event_id % 5 <> 0),
    resolved AS (SELECT request_id, action, trigger, stage, input_type, original_content AS original, coalesce(nullif(final_content, ''), suggested_content) AS final FROM requests JOIN resolutions USING (request_id))"""


def _resolved(s, d):
    return H.resolve(requests(s, d), resolutions(s, d))


def _review(rows):
    return rows.select("event_id", "review.trigger", F.md5("review.reason").alias("reason"))


QUERIES = {
    "v1_test_set": lambda s, d: V.test_set(cases(s, d), topic="algebra", tag="even").select("case_id", "topic"),
    "v1_test_set_summary": lambda s, d: V.test_set_summary(cases(s, d)),
    "v2_eval_retrieval": v2,
    "v3_eval_answers": lambda s, d: _answers(s, d),
    "v4_accuracy_by_topic": lambda s, d: V.accuracy_by_topic(_answers(s, d)).select(F.coalesce("topic", F.lit("all")).alias("topic"), "n", F.round("accuracy", 6).alias("accuracy")),
    "v5_eval_screening": v5,
    "v6_eval_log": lambda s, d: V.eval_log(problems(s, d), M.feedback_stats(feedback(s, d)), M.correction_counts(corrections(s, d))),
    "v7_report": lambda s, d: V.report(_metrics(s, d)).select("component", F.round("percentage", 6).alias("percentage"), "grade"),
    "v8_rag_relevance": v8,
    "v9_heuristic_judge": lambda s, d: _judged(s, d).select("id", F.round("solution_quality", 6).alias("solution_quality"), "explanation_clarity", F.array_join("issues", ",").alias("issues")),
    "v10_evaluate": lambda s, d: _evals(s, d).withColumn("overall", F.round("overall", 9)).select("id", "overall", V.letter(F.col("overall")).alias("grade"), (F.col("overall") >= 0.6).alias("passed"), F.array_join("notes", ",").alias("notes")),
    "v11_evaluation_stats": lambda s, d: V.evaluation_stats(_evals(s, d).withColumn("overall", F.round("overall", 9)).withColumn("grade", V.letter(F.col("overall"))).withColumn("passed", F.col("overall") >= 0.6)).select("metric", "name", "n", F.round("overall", 6).alias("overall"), F.round("pass_rate", 6).alias("pass_rate")),
    "v12_evaluation_history": lambda s, d: V.evaluation_history(_evals(s, d)).select("id", F.round("overall", 6).alias("overall")),
    "h1_route_extractions": lambda s, d: _review(H.route_extractions(extractions(s, d))),
    "h2_route_parses": lambda s, d: _review(H.route_parses(parses(s, d))),
    "h3_route_verifications": lambda s, d: _review(H.route_verifications(parses(s, d))),
    "h4_route_warnings": lambda s, d: H.route_warnings(S.screen_inputs(texts(s, d))).select("doc_id", "reason", "review_confidence"),
    "h5_resolve": lambda s, d: _resolved(s, d).select("request_id", "action", F.md5("final").alias("final"), F.col("correction").isNotNull().alias("corrects")),
    "h6_pending": lambda s, d: H.pending(requests(s, d), resolutions(s, d)).select("request_id", "trigger"),
    "h7_review_stats": lambda s, d: (lambda r: r.select("metric", "name", F.round("value", 6).alias("value")))(H.review_stats(requests(s, d), _resolved(s, d))),
    "h8_learning_signals": lambda s, d: H.learning_signals(_resolved(s, d)).select("request_id", "input_type", F.md5("original_text").alias("original_text"), "corrected_text", "learn"),
    "h9_review_display": lambda s, d: requests(s, d).select("request_id", H.band(F.col("confidence_score")).alias("band"), H.title(F.col("trigger")).alias("title")),
    "t5_resolved_in_time": lambda s, d: H.resolved_in_time(requests(s, d), resolutions(s, d)),
}

REL = f"(contains(lower(h.topic), c.topic) OR contains(lower(h.content), c.word) OR len(list_filter({W('lower(c.answer)')}, lambda x: contains(lower(h.content), x))) / len({W('lower(c.answer)')}) >= 0.3)"
ANS = "regexp_replace(replace(replace(replace(replace(" + D.squeeze("lower({})") + ", '²', '^2'), '³', '^3'), '×', '*'), '÷', '/'), '([0-9])\\s*\\*\\s*([0-9])', '\\1*\\2', 'g')"
CORRECT = f"judged AS (SELECT c.case_id, c.topic, contains({ANS.format('coalesce(h.content, chr(32))')}, {ANS.format('c.word')}) OR contains({ANS.format('coalesce(h.content, chr(32))')}, '42') AS correct FROM cases c LEFT JOIN hits h ON c.case_id = h.case_id AND h.rank = 1)"
STOP = "[" + ", ".join(map(D.q, V.STOP_WORDS)) + "]"
ORACLE_SQL = {
    "v1_test_set": f"WITH {CASES} SELECT case_id, topic FROM cases WHERE topic = 'algebra' AND tag = 'even'",
    "v1_test_set_summary": f"WITH {CASES} SELECT 'total' AS metric, '' AS name, count(*) AS n FROM cases UNION ALL SELECT 'topic', topic, count(*) FROM cases GROUP BY topic UNION ALL SELECT 'difficulty', d::VARCHAR, count(case_id) FROM range(1, 6) r(d) LEFT JOIN cases ON difficulty = d GROUP BY d",
    "v2_eval_retrieval": f"""WITH {CASES}, {HITS}, b AS (SELECT c.case_id, min(CASE WHEN {REL} AND h.rank <= 5 THEN h.rank END) AS first_at, coalesce(bool_or(h.rank = 1 AND contains(lower(h.topic), c.topic)), false) AS topical, sum(h.score) AS s, count(h.score) AS n FROM cases c LEFT JOIN hits h USING (case_id) GROUP BY c.case_id)
        SELECT count(*) AS cases, round(avg((first_at IS NOT NULL)::INT), 6) AS hit_rate, round(avg(topical::INT), 6) AS topic_accuracy, round(avg(coalesce(1.0 / first_at, 0)), 6) AS mrr, round(sum(s) / sum(n), 6) AS mean_score FROM b""",
    "v3_eval_answers": f"WITH {CASES}, {HITS}, {CORRECT} SELECT * FROM judged",
    "v4_accuracy_by_topic": f"WITH {CASES}, {HITS}, {CORRECT} SELECT coalesce(topic, 'all') AS topic, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM judged GROUP BY ROLLUP (topic)",
    "v6_eval_log": f"WITH {PROBLEMS}, {FEEDBACK}, {COUNTS} SELECT least((SELECT count(*) FROM problems) / 10, 1) AS storage, least((SELECT count(*) FROM feedback) / 5, 1) AS feedback, (SELECT avg(is_correct::INT) FROM feedback) AS accuracy, least((SELECT count(*) FROM counts) / 3, 1) AS corrections",
    "v7_report": f"WITH {METRICS} SELECT component, round(percentage, 6) AS percentage, {GRADE('percentage')} AS grade FROM rep",
    "v8_rag_relevance": f"""WITH {HITS}, b AS (SELECT item_id AS query_id, list_filter(list_distinct({W('lower(text)')}), lambda w: NOT list_contains({STOP}, w)) AS keys FROM benchmark),
        r AS (SELECT query_id, rank, CASE WHEN rank IS NOT NULL THEN 0.5 * coalesce(len(list_filter(keys, lambda k: contains(lower(content), k))) / nullif(len(keys), 0), 0) + 0.5 * least(score, 1) END AS s FROM b LEFT JOIN hits ON query_id = case_id AND rank <= 5)
        SELECT query_id, count(s) AS n_docs, round(coalesce(least(0.6 * avg(s) + 0.4 * min_by(s, rank), 1), 0), 6) AS relevance, CASE WHEN min_by(s, rank) > 0.4 THEN 'relevant' WHEN min_by(s, rank) > 0.2 THEN 'partially relevant' WHEN min_by(s, rank) IS NOT NULL THEN 'low relevance' END AS first_label FROM r GROUP BY query_id""",
    "v9_heuristic_judge": f"WITH {JUDGED} SELECT id, round(solution_quality, 6) AS solution_quality, explanation_clarity, issues FROM judged",
    "v10_evaluate": f"WITH {EVALS} SELECT id, round(overall, 9) AS overall, grade, passed, concat_ws(',', CASE WHEN confidence < 0.5 THEN 'low confidence' END, CASE WHEN n_docs = 0 THEN 'no documents' END, CASE WHEN edited THEN 'edited' END) AS notes FROM evals",
    "v11_evaluation_stats": f"""WITH {EVALS}, k AS (SELECT coalesce(topic, 'unknown') AS topic, input_type, grade, round(overall, 9) AS overall, passed FROM evals)
        SELECT 'all' AS metric, '' AS name, count(*) AS n, round(avg(overall), 6) AS overall, round(avg(passed::INT), 6) AS pass_rate FROM k
        UNION ALL SELECT 'topic', topic, count(*), round(avg(overall), 6), round(avg(passed::INT), 6) FROM k GROUP BY topic
        UNION ALL SELECT 'input_type', input_type, count(*), round(avg(overall), 6), round(avg(passed::INT), 6) FROM k GROUP BY input_type
        UNION ALL SELECT 'grade', grade, count(*), round(avg(overall), 6), round(avg(passed::INT), 6) FROM k GROUP BY grade""",
    "v12_evaluation_history": f"WITH {EVALS} SELECT id, round(overall, 6) AS overall FROM evals ORDER BY created_at DESC, id LIMIT 50",
    "h1_route_extractions": f"""WITH {EXTRACTIONS}, r AS (SELECT *, error IS NOT NULL OR length(extracted_text) < 3 AS failed, CASE WHEN input_type = 'image' THEN 0.7 ELSE 0.65 END AS lim FROM ex),
        t AS (SELECT *, CASE WHEN input_type = 'text' THEN NULL WHEN failed THEN 'extraction_failed' WHEN confidence < lim THEN CASE WHEN input_type = 'image' THEN 'ocr_low_confidence' ELSE 'asr_low_confidence' END END AS trigger FROM r)
        SELECT event_id, trigger, CASE WHEN trigger IS NOT NULL THEN md5(CASE WHEN error IS NOT NULL THEN 'failed: ' || error WHEN failed THEN 'empty or very short' ELSE {PCT('confidence')} || ' is below ' || {PCT('lim')} END) END AS reason FROM t""",
    "h2_route_parses": f"WITH {PARSED} SELECT event_id, trigger, CASE WHEN trigger IS NOT NULL THEN md5(CASE WHEN reason = '' THEN 'needs clarification' ELSE reason END) END AS reason FROM pa",
    "h3_route_verifications": f"WITH {VERIFIED} SELECT event_id, trigger, CASE WHEN trigger IS NOT NULL THEN md5(reason) END AS reason FROM ve",
    "h5_resolve": f"WITH {REVIEWS} SELECT request_id, action, md5(final) AS final, action = 'edited' AND final <> original AS corrects FROM resolved",
    "h6_pending": f"WITH {REVIEWS} SELECT request_id, trigger FROM requests WHERE request_id NOT IN (SELECT request_id FROM resolutions)",
    "h7_review_stats": f"""WITH {REVIEWS} SELECT 'total' AS metric, '' AS name, count(*)::DOUBLE AS value FROM resolved UNION ALL SELECT 'action', action, count(*) FROM resolved GROUP BY action
        UNION ALL SELECT 'trigger', trigger, count(*) FROM resolved GROUP BY trigger UNION ALL SELECT 'stage', stage, count(*) FROM resolved GROUP BY stage
        UNION ALL SELECT 'pending', '', count(*) FROM requests WHERE request_id NOT IN (SELECT request_id FROM resolved)
        UNION ALL SELECT 'rate', a, round(avg((action = a)::INT), 6) FROM resolved, (VALUES ('edited'), ('approved'), ('rejected')) v(a) GROUP BY a""",
    "h8_learning_signals": f"WITH {REVIEWS} SELECT request_id, input_type, md5(substr(original, 1, 500)) AS original_text, substr(final, 1, 500) AS corrected_text, action = 'edited' AND stage = 'extraction' AND input_type IN ('image', 'audio') AS learn FROM resolved",
    "h9_review_display": "SELECT event_id::VARCHAR AS request_id, CASE WHEN value / 500 >= 0.8 THEN 'High' WHEN value / 500 >= 0.5 THEN 'Medium' ELSE 'Low' END AS band, array_to_string(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS title FROM events WHERE event_id % 2 = 0",
    "t5_resolved_in_time": f"WITH {REVIEWS} SELECT q.request_id, coalesce(r.action, 'auto_skipped') AS status FROM requests q LEFT JOIN resolutions r ON q.request_id = r.request_id AND r.resolved_at BETWEEN q.created_at AND q.created_at + INTERVAL 300 SECOND",
}
