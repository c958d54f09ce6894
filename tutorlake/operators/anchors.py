"""Anchor classifier: is a text mathematical, by its vector's nearness to labelled anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorlake.operators.search import cosine

TOP = 5


def classify(texts: DataFrame, anchors: DataFrame, boost: Column | None = None, most: int = 1000) -> DataFrame:
    """(id, is_math, confidence, topic) of rows (id, embedding). Of each side, the mean of the
    largest cosine and of the average of the five largest; the sigmoid of 12 times the difference
    plus the rule boost decides at one half.

    anchors (is_math, topic, embedding) are a fixed small set and travel as one broadcast row, which
    is why more than ``most`` are refused; each text is compared in its own row, without a shuffle."""
    if (n := anchors.count()) > most:
        raise ValueError(f"{n} anchors; at most {most} can be broadcast")
    one = anchors.agg(F.collect_list(F.struct("is_math", "topic", F.col("embedding").alias("v"))).alias("anchors"))
    rows = texts.join(F.broadcast(one))
    scored = F.transform("anchors", lambda a: F.struct(cosine(F.col("embedding"), a["v"]).alias("s"), a["topic"].alias("topic"), a["is_math"].alias("m")))

    def side(m: bool) -> Column:
        return F.reverse(F.array_sort(F.filter("scored", lambda a: a["m"] == F.lit(m))))

    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda t, x: t + x["s"]), F.size(a))
    value = lambda a: F.coalesce((F.get(a, F.lit(0))["s"] + mean(F.slice(a, 1, TOP))) / 2, F.lit(0.0))
    rows = rows.withColumn("scored", scored).withColumn("yes", side(True)).withColumn("no", side(False))
    conf = F.least(F.lit(1.0), 1 / (1 + F.exp(-12 * (value(F.col("yes")) - value(F.col("no"))))) + (boost if boost is not None else F.lit(0.0)))
    return rows.withColumn("confidence", conf).select("id", (F.col("confidence") >= 0.5).alias("is_math"), "confidence", F.get("yes", F.lit(0))["topic"].alias("topic"))
