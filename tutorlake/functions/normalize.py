"""Normalising of texts, answers and replies as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tutorlake.functions import rules as R
from tutorlake.functions.text import chain, contains_any, count_contained, has, rx, squeeze, strip, words


def spoken_math(text: Column, ascii_words: bool = False) -> Column:
    """Spoken maths as signs: lower case, rule after rule, white space squeezed. With ``ascii_words``
    only ASCII letters, digits and underscores are parts of a word, so that a rule's word also ends
    before an accented letter."""
    rules = [(p, r.replace("$", "\\$")) for p, r in R.SPOKEN]
    if ascii_words:  # every rule begins and ends with a border
        rules = [("(?<![0-9A-Za-z_])" + p.removeprefix(r"\b").removesuffix(r"\b") + "(?![0-9A-Za-z_])", r) for p, r in rules]
    return squeeze(chain(F.lower(text), rules))


def cache_key(text: Column) -> Column:
    """Lower case, white space squeezed, marks at the end dropped."""
    return F.regexp_replace(squeeze(F.lower(text)), r"[?.!,;:]+$", "")


def reply_text(text: Column) -> Column:
    """Written-out line feeds become real, four or more in a row three, doubled escapes single."""
    text = F.regexp_replace(F.replace(text, F.lit("\\n"), F.lit("\n")), "\n{4,}", "\n\n\n")
    return F.regexp_replace(text, r"\\\\([a-zA-Z])", r"\\$1")


def answer(text: Column) -> Column:
    text = squeeze(F.lower(text))
    for a, b in (("²", "^2"), ("³", "^3"), ("×", "*"), ("÷", "/")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, rx(r"(\d)\s*\*\s*(?=\d)"), "$1*")


def difficulty(question: Column) -> Column:
    """'simple' or 'complex' where rules are sure, else null."""
    low = strip(F.lower(question))
    n, hits = F.size(words(low)), count_contained(low, R.COMPLEX)
    return F.when(has(low, "|".join(f"(?:{p})" for p in R.SIMPLE)) | (n <= 5), "simple").when((hits >= 2) | ((hits >= 1) & (n > 25)), "complex")


def route(level: Column) -> Column:
    return F.when(level == "complex", "full").otherwise("fast")


#: Every match of the rules of signs holds one of these (fixed values).
SIGNS = ["^2", "^3", "²", "³", "√", "∫", "∑", "π", "d/dx", "dy/dx"]


def clean_for_tokens(text: Column) -> Column:
    """Signs as words; a text without any is left as it is."""
    return F.when(contains_any(text, SIGNS), chain(text, R.TOKEN_SIGNS)).otherwise(text)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def spaced(text: Column) -> Column:
    """The ``tokens`` of a text with a space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def assemble_ocr(found: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, text, confidence, n_words) of every image from rows (image_id, word_no, text,
    conf); words without text or confidence drop out, an image without words has none."""
    good = found.where((F.col("conf") > 0) & (F.trim("text") != ""))
    by = good.groupBy("image_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", F.trim("text").alias("w")))), lambda x: x["w"]), " ").alias("text"),
        (F.avg("conf") / 100).alias("confidence"),
        F.count("*").alias("n_words"),
    )
    got = images.select("image_id").distinct().join(by, "image_id", "left")
    return got.select("image_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.col("text").isNull().alias("error"))


def apply_corrections(texts: DataFrame, patterns: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """``texts`` with ``corrected``: the learned replacements of its input type seen ``least`` times
    or more, most frequent first, one after the other. There are few input types, and each one's
    replacements are one array; the join is on the type."""
    known = patterns.where(F.col("frequency") >= least).groupBy("input_type").agg(F.sort_array(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "original_text", "corrected_text"))).alias("__known"))
    got = texts.join(known, "input_type", "left")
    fixed = F.aggregate(F.coalesce("__known", F.array().cast(known.schema["__known"].dataType)), F.col(text), lambda t, p: F.when(p["original_text"] == "", t).otherwise(F.replace(t, p["original_text"], p["corrected_text"])))
    return got.withColumn("corrected", fixed).drop("__known")


def parse_replies(df: DataFrame, schema: str, reply: str = "reply") -> DataFrame:
    """``df`` with ``parsed``: JSON out of a model's reply. Tried in turn: the reply without its
    code fence, the same with lone backslashes doubled, the outermost braces; null if none parses."""
    kind = StructType.fromDDL(schema)
    bare = strip(F.regexp_replace(F.regexp_replace(F.col(reply), r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)\s*```.*$", ""))
    body = F.when(F.col(reply).contains("```"), bare).otherwise(strip(F.col(reply)))
    doubled = F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\")
    braces = F.regexp_extract(F.col(reply), r"(?s)\{.*\}", 0)

    def read(c: Column) -> Column:
        got = F.from_json(c, kind)
        return F.when(F.startswith(c, F.lit("{")) & reduce(Column.__or__, (got[f.name].isNotNull() for f in kind)), got)

    return df.withColumn("parsed", F.coalesce(read(body), read(doubled), read(braces)))
