"""Scoring of retrieval, answers and screening, and reports over the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorlake.functions.normalize import answer
from tutorlake.functions.text import contains_any, strip, words

#: Words that say nothing about a question (fixed values).
STOP_WORDS = "the a an is are was were find solve what how of in for to and or if it this that with".split()
STEP_WORDS = ["step", "first", "then", "therefore", "thus", "hence", "so,"]


def test_set(cases: DataFrame, topic: str | None = None, difficulty: int | None = None, tag: str | None = None, case_id: str | None = None) -> DataFrame:
    """The cases that match all given conditions."""
    for column, value in (("topic", topic), ("difficulty", difficulty), ("case_id", case_id)):
        if value is not None:
            cases = cases.where(F.col(column) == value)
    return cases if tag is None else cases.where(F.array_contains("tags", tag))


def test_set_summary(cases: DataFrame) -> DataFrame:
    """(metric, name, n): total, by topic, and by difficulty 1 to 5, zero included."""
    spark = cases.sparkSession
    total = cases.agg(F.count("*").alias("n")).select(F.lit("total").alias("metric"), F.lit("").alias("name"), "n")
    topics = cases.groupBy("topic").agg(F.count("*").alias("n")).select(F.lit("topic").alias("metric"), F.col("topic").alias("name"), "n")
    levels = spark.range(1, 6).select(F.col("id").cast("int").alias("difficulty")).join(cases.groupBy("difficulty").agg(F.count("*").alias("n")), "difficulty", "left")
    return total.unionByName(topics).unionByName(levels.select(F.lit("difficulty").alias("metric"), F.col("difficulty").cast("string").alias("name"), F.coalesce("n", F.lit(0)).alias("n")))


def relevant(topic: Column, content: Column, expected_topic: Column, keywords: Column, answer_text: Column) -> Column:
    """A hit is relevant if its topic holds the expected one, its content an expected keyword, or
    three tenths of the answer's words."""
    low, parts = F.lower(content), words(F.lower(answer_text))
    share = F.try_divide(F.size(F.filter(parts, lambda w: F.contains(low, w))), F.size(parts))
    return F.contains(F.lower(topic), F.lower(expected_topic)) | F.exists(keywords, lambda k: F.contains(low, F.lower(k))) | F.coalesce(share >= 0.3, F.lit(False))


def eval_retrieval(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """One row: hit@k, share of first hits in the expected topic, mean reciprocal rank and mean
    score. cases: case_id, expected_topic, keywords, answer; hits: case_id, rank, topic, content,
    score. Cases without hits count."""
    both = cases.join(hits, "case_id", "left")
    ok = F.coalesce(relevant(F.col("topic"), F.col("content"), F.col("expected_topic"), F.col("keywords"), F.col("answer")), F.lit(False)) & (F.col("rank") <= k)
    first_topic = (F.col("rank") == 1) & F.contains(F.lower("topic"), F.lower("expected_topic"))
    by = both.groupBy("case_id").agg(F.min(F.when(ok, F.col("rank"))).alias("at"), F.bool_or(F.coalesce(first_topic, F.lit(False))).alias("topical"), F.sum("score").alias("s"), F.count("score").alias("n"))
    share = lambda c: F.avg(c.cast("double"))
    return by.agg(
        F.count("*").alias("cases"), share(F.col("at").isNotNull()).alias("hit_rate"), share(F.col("topical")).alias("topic_accuracy"),
        F.avg(F.coalesce(1 / F.col("at"), F.lit(0.0))).alias("mrr"), F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("mean_score"),
    )


def eval_answers(cases: DataFrame, solutions: DataFrame) -> DataFrame:
    """(case_id, topic, correct): an accepted answer, normalised, is in the normalised solution."""
    both = cases.join(solutions, "case_id", "left")
    text = answer(F.coalesce("solution", F.lit("")))
    return both.select("case_id", "topic", F.exists("accepted", lambda a: F.contains(text, answer(a))).alias("correct"))


def judge_says_correct(reply: Column) -> Column:
    """The verdict begins with CORRECT (a plain search would also find it in INCORRECT)."""
    return F.upper(reply).rlike(r"^\s*CORRECT\b")


def accuracy_by_topic(judged: DataFrame) -> DataFrame:
    """(topic, n, accuracy) by topic and, as topic null, overall."""
    return judged.rollup("topic").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def eval_screening(labelled: DataFrame) -> DataFrame:
    """One row from (should_pass, passed): counts, accuracy, the two shares 1 - n / total, and the
    true rates of false alarms and misses."""
    wrong_stop, wrong_pass = F.col("should_pass") & ~F.col("passed"), ~F.col("should_pass") & F.col("passed")
    got = labelled.agg(F.count("*").alias("total"), F.count_if(F.col("should_pass") == F.col("passed")).alias("right"), F.count_if(wrong_stop).alias("false_positives"), F.count_if(wrong_pass).alias("false_negatives"), F.count_if("should_pass").alias("good"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    return got.select(
        "total", "false_positives", "false_negatives", rate(c("right"), c("total")).alias("accuracy"), (1 - rate(c("false_positives"), c("total"))).alias("without_false_positives"),
        (1 - rate(c("false_negatives"), c("total"))).alias("without_false_negatives"), rate(c("false_positives"), c("good")).alias("false_alarm_rate"), rate(c("false_negatives"), c("total") - c("good")).alias("miss_rate"),
    )


def eval_log(problems: DataFrame, feedback_stats: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of 0-to-1 figures on how well the log is filled."""
    n, c = problems.agg(F.count("*").alias("problems")), counts.agg(F.count("*").alias("patterns"))
    cap = lambda x, most: F.least(x / most, F.lit(1.0))
    return n.join(feedback_stats).join(c).select(cap(F.col("problems"), 10).alias("storage"), cap(F.col("total"), 5).alias("feedback"), F.col("accuracy"), cap(F.col("patterns"), 3).alias("corrections"))


def grade(percent: Column) -> Column:
    return F.when(percent >= 90, "A").when(percent >= 80, "B").when(percent >= 70, "C").when(percent >= 60, "D").otherwise("F")


def report(metrics: DataFrame) -> DataFrame:
    """(component, percentage, grade, line) from (component, metric, value, max_value); the mean of
    the components comes as component 'overall'."""
    each = metrics.withColumn("p", F.coalesce(F.try_divide(F.col("value") * 100, F.col("max_value")), F.lit(0.0)))
    by = each.groupBy("component").agg(F.avg("p").alias("percentage"))
    rows = by.unionByName(by.agg(F.avg("percentage").alias("percentage")).select(F.lit("overall").alias("component"), "percentage"))
    g = grade(F.col("percentage"))
    return rows.select("component", "percentage", g.alias("grade"), F.format_string("- %s: %.1f%% (%s)", F.col("component"), F.coalesce("percentage", F.lit(0.0)), g).alias("line"))


def report_text(metrics: DataFrame) -> DataFrame:
    """The report's lines as one text."""
    return report(metrics).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("component", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def rag_relevance(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n_docs, relevance, first_label): half keyword overlap, half score by document; 0.6
    of their mean and 0.4 of the first. Questions without documents get 0."""
    keys = F.array_except(F.array_distinct(words(F.lower("question"))), F.array(*map(F.lit, STOP_WORDS)))
    both = questions.select("query_id", keys.alias("keys")).join(hits, "query_id", "left")
    low = F.lower(F.coalesce("content", F.lit("")))
    overlap = F.coalesce(F.try_divide(F.size(F.filter("keys", lambda k: F.contains(low, k))), F.size("keys")), F.lit(0.0))
    both = both.withColumn("s", F.when(F.col("rank").isNotNull(), 0.5 * overlap + 0.5 * F.least("score", F.lit(1.0))))
    by = both.groupBy("query_id").agg(F.count("s").alias("n_docs"), F.avg("s").alias("mean"), F.min_by("s", "rank").alias("first"))
    value = F.coalesce(F.least(0.6 * F.col("mean") + 0.4 * F.col("first"), F.lit(1.0)), F.lit(0.0))
    label = F.when(F.col("first") > 0.4, "relevant").when(F.col("first") > 0.2, "partially relevant").when(F.col("first").isNotNull(), "low relevance")
    return by.select("query_id", "n_docs", value.alias("relevance"), label.alias("first_label"))


def heuristic_judge(df: DataFrame, solution: str = "solution", explanation: str = "explanation") -> DataFrame:
    """``df`` with solution_quality, explanation_clarity and issues, by length and words."""
    s, e = F.coalesce(F.col(solution), F.lit("")), F.coalesce(F.col(explanation), F.lit(""))
    low, none, silent = F.lower(s), strip(s) == "", strip(e) == ""
    points = 0.5 + F.when(contains_any(low, STEP_WORDS), 0.2).otherwise(0.0) + F.when(contains_any(low, ["final answer", "answer:"]), 0.1).otherwise(0.0)
    points = points + F.when(F.length(s) < 50, -0.2).when(F.length(s) > 200, 0.1).otherwise(0.0)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    issues = F.array_compact(F.array(F.when(none, F.lit("no solution")), F.when(~none & (F.length(s) < 50), F.lit("very short")), F.when(silent, F.lit("no explanation"))))
    df = df.withColumn("solution_quality", F.when(none, 0.0).otherwise(clip(points)))
    return df.withColumn("explanation_clarity", F.when(silent, 0.0).when(F.length(e) > 100, 0.7).otherwise(0.5)).withColumn("issues", issues)


def letter(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def evaluate(df: DataFrame) -> DataFrame:
    """``df`` (rag_relevance, solution_quality, explanation_clarity, confidence, n_docs, edited) with
    overall, grade, passed and notes."""
    total = 0.2 * F.col("rag_relevance") + 0.5 * F.col("solution_quality") + 0.3 * F.col("explanation_clarity")
    notes = F.array_compact(F.array(F.when(F.col("confidence") < 0.5, F.lit("low confidence")), F.when(F.col("n_docs") == 0, F.lit("no documents")), F.when(F.col("edited"), F.lit("edited"))))
    df = df.withColumn("overall", total)
    return df.withColumn("grade", letter(F.col("overall"))).withColumn("passed", F.col("overall") >= 0.6).withColumn("notes", notes)


def evaluation_stats(evals: DataFrame) -> DataFrame:
    """(metric, name, n, overall): all, by topic, by input type and by grade, in one pass."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    rows = evals.select(known("topic"), known("input_type"), "grade", "overall", "passed")
    sets = rows.groupingSets([["topic"], ["input_type"], ["grade"], []], "topic", "input_type", "grade").agg(F.count("*").alias("n"), F.avg("overall").alias("overall"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.grouping_id().alias("g"))
    metric = F.when(F.col("g") == 3, "topic").when(F.col("g") == 5, "input_type").when(F.col("g") == 6, "grade").otherwise("all")
    return sets.select(metric.alias("metric"), F.coalesce("topic", "input_type", "grade", F.lit("")).alias("name"), "n", "overall", "pass_rate")


def evaluation_history(evals: DataFrame, n: int = 50) -> DataFrame:
    return evals.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(n)
