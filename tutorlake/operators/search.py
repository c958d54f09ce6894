"""Keyword and vector search over tables of questions, fusion, and what is shown of the hits.

Scores tie by chunk id. Questions are the small side of every join; postings are joined to
question terms only, so the corpus's postings are never moved for terms nobody asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorlake.functions.normalize import clean_for_tokens, tokens
from tutorlake.functions.rules import EXPANSIONS
from tutorlake.functions.text import chain, has, once, rx, strip, words
from tutorlake.operators import segments
from tutorlake.sources.shared import kept

K1, B, EPSILON = 1.5, 0.75, 0.25  # public BM25 defaults
MIN_CONTENT, MAX_SECTION = 50, 3000
#: Rows of a side that may be broadcast, once they are counted.
SMALL = 200_000
#: Texts that are encoded at once.
ENCODED = 512


def few(df: DataFrame) -> DataFrame:
    """``df`` written once, and broadcast where its counted rows are few, so that the other side of a
    join, which has the texts, is not moved."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def ranked(df: DataFrame, by: Column, k: int, *ties: str) -> DataFrame:
    """The first k rows of each query by ``by`` from high to low, with ``rank``."""
    w = Window.partitionBy("query_id").orderBy(by.desc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- keywords -----------------------------------------------------------------------------------
def postings(chunks: DataFrame, text: str = "content", key: str = "chunk_id", only: DataFrame | None = None) -> DataFrame:
    """(chunk_id, term, tf, size): terms of each chunk with their counts; of those in ``only`` if given,
    the others being dropped before anything is shuffled."""
    toks = tokens(clean_for_tokens(F.coalesce(F.col(text), F.lit(""))))
    rows = once(chunks.select(F.col(key).alias("chunk_id"), F.col(text)), t=toks).select("chunk_id", F.size("t").alias("size"), F.explode("t").alias("term"))
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("chunk_id", "size", "term").agg(F.count("*").alias("tf"))


def bm25_stats(chunks: DataFrame, text: str = "content", key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Corpus (one row: n, avg_size, mean_idf) and terms (term, df, idf). A term in more than half
    of the chunks has a negative idf; EPSILON times the mean idf of all terms stands in for it."""
    toks = tokens(clean_for_tokens(F.coalesce(F.col(text), F.lit(""))))
    rows = once(chunks.select(text), t=toks).select(F.size("t").alias("size"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
    # One pass: each chunk adds a row without a term, so that row's group tells the number of chunks
    # and of words. Both parts below read both aggregates, and no condition on
    # the term reaches below the aggregation, so that Spark computes it once.
    counts = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("size"))).alias("total"))
    corpus = counts.where("total is not null").agg(F.coalesce(F.max("df"), F.lit(0).cast("long")).alias("n"), (F.max("total") / F.max("df")).alias("avg_size"))
    raw = counts.where("total is null").select(F.coalesce("term", F.lit("")).alias("term"), "df").join(F.broadcast(corpus.select("n")))
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.coalesce(F.avg("raw"), F.lit(0.0)).alias("mean_idf"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return corpus.join(mean), terms


def bm25_scores(queries: DataFrame, chunks: DataFrame, text: str = "content", key: str = "chunk_id") -> DataFrame:
    """(query_id, chunk_id, score); a term counts as often as the query has it."""
    corpus, terms = bm25_stats(chunks, text, key)
    wanted = queries.select("query_id", F.explode(tokens(clean_for_tokens(F.col("query")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = wanted.join(terms, "term").join(F.broadcast(corpus.select("avg_size")))
    tf, size = F.col("tf"), F.col("size")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.col("avg_size")))
    return postings(chunks, text, key, wanted).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def bm25_topk(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, score): divided by the query's best, positive ones only."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    scaled = scores.withColumn("score", F.round(F.col("score") / F.when(top <= 0, F.lit(1.0)).otherwise(top), 9)).where("score > 0")
    return ranked(scaled, F.col("score"), k, "chunk_id").select("query_id", "rank", "chunk_id", "score")


# --- vectors ------------------------------------------------------------------------------------
def encode(df: DataFrame, text: str = "text", key: str = "id", encoder: Callable | None = None, size: int = 64) -> DataFrame:
    """(id, embedding) by a callable list[str] -> array (n, size), in Arrow batches; without one a
    deterministic hashed bag of words, L2-normalised."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = encoder or (lambda t: hashed_bag(t, size))
        for batch in batches:
            for lo in range(0, batch.num_rows, ENCODED):  # Python holds the strings of a slice alone
                ids, texts = batch.slice(lo, ENCODED).columns
                v = np.asarray(f([t or "" for t in texts.to_pylist()]), np.float32)
                ends = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(v.ravel(), pa.float32()))], names=["id", "embedding"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>")


def encoded(df: DataFrame, text: str = "text", encoder: Callable | None = None, size: int = 64) -> DataFrame:
    """``df`` with ``embedding`` as a column, which steps that do not read it do not compute."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        f = encoder or (lambda t: hashed_bag(t, size))
        t = [x if isinstance(x, str) else "" for x in texts]
        return pd.Series([v for lo in range(0, len(t), ENCODED) for v in np.asarray(f(t[lo : lo + ENCODED]), np.float32)], dtype=object)

    return df.withColumn("embedding", run(F.col(text)))


@lru_cache(100_000)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:4], "big")


def hashed_bag(texts: list[str], size: int = 64) -> np.ndarray:
    """Each word adds or takes one at a slot, both by its hash; then rows of length one."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts):
        h = np.fromiter(map(_word_hash, re.findall(r"\w+", text.lower())), np.int64)
        row += np.bincount(h % size, np.where(h >> 31, 1.0, -1.0), size)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def normalize(v: Column, eps: float = 1e-8) -> Column:
    n = norm(v) + eps
    return F.transform(v, lambda x: x / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


#: Chunks and queries of a cell of the grid, about, and queries of one product, which bound what a
#: task's Python holds: a product takes 8 MB.
CELL_CHUNKS, CELL_QUERIES, PRODUCT_ROWS = 16_384, 20_000, 64


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, key: str = "chunk_id", within: str | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score): exact top k by inner product, among the chunks with the
    query's value of ``within`` if a column is named.

    A grid: queries and chunks of a value of ``within`` are dealt into blocks of bounded size, as many
    as their counted rows ask for, and each pair of blocks is a cell, which multiplies two matrices
    and keeps k a query. Nothing is collected, and the plan is the same for any number of queries."""
    group = F.lit("") if within is None else F.col(within).cast("string")
    asked = queries.where("embedding is not null").select(F.col("query_id").alias("id"), F.col("embedding").alias("vector"), group.alias("g")).where("g is not null")
    rows = chunks.where("embedding is not null").select(F.col(key).alias("id"), F.col("embedding").alias("vector"), group.alias("g")).where("g is not null")
    size = lambda df, per, name: df.groupBy("g").agg(F.ceil(F.count("*") / per).cast("int").alias(name))
    grid = size(asked, CELL_QUERIES, "down").join(size(rows, CELL_CHUNKS, "across"), "g")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(grid, "g").select("id", "vector", "g", own("down").alias("i"), other("across").alias("j"))
    rows = rows.join(grid, "g").select("id", "vector", "g", own("across").alias("j"), other("down").alias("i"))
    qkind, kind = queries.schema["query_id"].dataType.simpleString(), chunks.schema[key].dataType.simpleString()

    def matrix(table: pa.Table) -> np.ndarray:
        v = table.column("vector").combine_chunks()
        return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c, score = [], [], []
        if left.num_rows and right.num_rows:
            a, b = matrix(left), matrix(right).T
            # ranked by id, so that of equal scores the smallest ids are kept
            order = right.column("id").combine_chunks()
            order = pa.compute.sort_indices(order).to_numpy()
            b, m = b[:, order], min(k, b.shape[1])
            for lo in range(0, len(a), PRODUCT_ROWS):
                s = np.round(a[lo : lo + PRODUCT_ROWS] @ b, 6)
                low = np.partition(s, -m, axis=1)[:, -m][:, None]
                above = s > low
                ties = (s == low) & ((s == low).cumsum(1) <= m - above.sum(1, keepdims=True))
                i, j = np.nonzero(above | ties)
                q.append(lo + i)
                c.append(order[j])
                score.append(s[i, j])
        take = lambda t, at: t.column("id").combine_chunks().take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)))
        return pa.table({"query_id": take(left, q), "chunk_id": take(right, c), "score": pa.array(np.concatenate(score) if score else np.zeros(0))})

    cells = asked.groupBy("g", "i", "j").cogroup(rows.groupBy("g", "i", "j")).applyInArrow(best, f"query_id {qkind}, chunk_id {kind}, score double")
    return ranked(cells, F.col("score"), k, "chunk_id").select("query_id", "rank", "chunk_id", "score")


def search_filtered(queries: DataFrame, chunks: DataFrame, k: int, condition: Column) -> DataFrame:
    """Three times k first, then the condition on the chunk's columns, then k: may give fewer."""
    near = vector_topk(queries, chunks, 3 * k).drop("rank").join(chunks.drop("embedding"), "chunk_id").where(condition)
    return ranked(near, F.col("score"), k, "chunk_id").select("query_id", "rank", "chunk_id", "score")


def search_in_topic(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Within the query's topic where chunks have it, else over all chunks."""
    known = chunks.select("topic").distinct()
    inside = vector_topk(queries.join(known, "topic", "left_semi"), chunks, k, within="topic")
    return inside.unionByName(vector_topk(queries.join(known, "topic", "left_anti"), chunks, k))


# --- fusion and display -------------------------------------------------------------------------
def fuse(semantic: DataFrame, keyword: DataFrame, alpha: float = 0.6) -> DataFrame:
    """(query_id, chunk_id, semantic, keyword, combined): what either side has; 0.1 more if both exceed 0.3."""
    s = semantic.select("query_id", "chunk_id", F.col("score").alias("semantic"))
    both = s.join(keyword.select("query_id", "chunk_id", F.col("score").alias("keyword")), ["query_id", "chunk_id"], "full_outer").fillna(0.0, ["semantic", "keyword"])
    boost = F.when((F.col("semantic") > 0.3) & (F.col("keyword") > 0.3), 0.1).otherwise(0.0)
    return both.withColumn("combined", F.round(alpha * F.col("semantic") + (1 - alpha) * F.col("keyword") + boost, 9))


def clean_chapter(chapter: Column) -> Column:
    text = strip(F.coalesce(chapter, F.lit("")))
    bare = F.regexp_replace(text, rx(r"^[.\s]+"), "")
    return F.when(F.lower(text).isin("", "blank page", "untitled", "unknown") | (bare == ""), "General").otherwise(bare)


def section_id(chapter: Column, section: Column) -> Column:
    return F.replace(F.concat_ws("_", clean_chapter(chapter), F.coalesce(section, F.lit(""))), F.lit(" "), F.lit("_"))


def sections(chunks: DataFrame, most: int = MAX_SECTION) -> DataFrame:
    """(section_id, chapter, section, topic, subtopic, full_content) in order of ``pos``: chunks until
    ``most`` characters, the first that overflows cut if over 200 remain, later ones left out."""
    rows = chunks.select("pos", "chapter", "section", "topic", "subtopic", "content", section_id(F.col("chapter"), F.col("section")).alias("section_id"), F.length("content").alias("n"), segments.range_of("pos").alias("at"))
    # Which ranges of a section are reached before ``most`` is told by lengths alone; the texts of no
    # others, and at most that much of each text, are moved.
    ranges = rows.groupBy("section_id", "at").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("section_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = kept(ranges.select("section_id", "at", before.alias("earlier")).where(F.col("earlier") <= most))
    rows = rows.withColumn("content", F.substring("content", 1, most)).join(F.broadcast(reached) if reached.count() <= SMALL else reached, ["section_id", "at"])
    running = F.sum("n").over(Window.partitionBy("section_id", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", F.col("earlier") + F.coalesce(running, F.lit(0))).withColumn("before", F.col("upto") - F.col("n")).where(F.col("before") <= most)
    part = F.when(F.col("upto") <= most, F.col("content")).when(most - F.col("before") > 200, F.concat(F.expr(f"substring(content, 1, cast({most} - before as int))"), F.lit("...")))
    found = rows.withColumn("part", part).where("part is not null or before = 0")
    return found.groupBy("section_id").agg(
        F.min_by(clean_chapter(F.col("chapter")), "pos").alias("chapter"), F.min_by("section", "pos").alias("section"), F.min_by("topic", "pos").alias("topic"), F.min_by("subtopic", "pos").alias("subtopic"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("pos", "part")))), lambda x: x["part"]), "\n\n").alias("full_content"),
    )


def candidates(fused: DataFrame, chunks: DataFrame, most: int, min_score: float, topic: str | None = None) -> DataFrame:
    """Best first: score, topic and length conditions, the first of equal 200-character beginnings,
    then the first of each section, the first ``most`` of a query."""
    rows = few(fused.where(F.col("combined") >= min_score)).join(chunks, "chunk_id").where(F.length("content") >= MIN_CONTENT)
    if topic is not None:
        rows = rows.where(F.contains(F.lower("topic"), F.lit(topic.lower())))
    rows = rows.withColumn("section_id", section_id(F.col("chapter"), F.col("section")))
    order = (F.desc("combined"), "chunk_id")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", F.substring("content", 1, 200)).orderBy(*order))).where("r = 1")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "section_id").orderBy(*order))).where("r = 1").drop("r")
    return ranked(rows, F.col("combined"), most, "chunk_id")


#: Titles by content type (fixed values).
TITLES = {"definition": "Definition", "theorem": "Theorem", "theorem_statement": "Theorem", "proof": "Proof", "example": "Example", "solved_example": "Solved Example", "solved_example_step": "Solved Example Step", "formula": "Formula", "text": "Content"}
BOXES = "⎛⎝⎞⎠│├└┘┐┌"


def hit_title(content_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, content_type), F.initcap(F.replace(content_type, F.lit("_"), F.lit(" "))))


def clean_content(text: Column, most: int = MAX_SECTION) -> Column:
    """For display: box characters, loose slashes, blank lines, part labels; cut at a full stop."""
    text = chain(F.coalesce(text, F.lit("")), [(f"[{BOXES}─═║╔╗╚╝╠╣╦╩╬]+", ""), (r"\s+/\s+", "/"), (r"\n{3,}", "\n\n"), (r" {2,}", " "), (r"\t+", " "), (r"^(Example|Definition|Theorem)\s*\(Part \d+/\d+\):\s*", "")])
    head = F.substring(text, 1, most)
    stop = F.lit(most + 1) - F.locate(".", F.reverse(head))  # place of the last full stop, most + 1 if none
    cut = F.when((stop <= most) & (stop - 1 > most * 0.7), F.substring(head, F.lit(1), stop)).otherwise(F.concat(head, F.lit("...")))
    return strip(F.when(F.length(text) > most, cut).otherwise(text))


def build_hits(cands: DataFrame, all_sections: DataFrame) -> DataFrame:
    """Candidates with title, chapter and what is shown: the section where it is half as long again."""
    rows = cands.join(all_sections.select("section_id", "full_content"), "section_id", "left")
    own, whole = clean_content(F.col("content")), clean_content(F.col("full_content"))
    shown = F.when(F.length(whole) > F.length(own) * 1.5, whole).otherwise(own)
    return rows.withColumn("title", hit_title(F.col("content_type"))).withColumn("chapter", clean_chapter(F.col("chapter"))).withColumn("shown", shown).drop("full_content")


def is_low_quality(text: Column) -> Column:
    """More than 5 % box characters, under 50 characters, or under 30 % ASCII letters."""
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    return (count(f"[{BOXES}]") / n > 0.05) | (F.length(strip(text)) < 50) | (count("[a-zA-Z]") / n < 0.3)


def pack_context(hits: DataFrame, max_tokens: int = 3000) -> DataFrame:
    """(query_id, context): numbered blocks by rank until 4 * max_tokens characters; the first that
    overflows is cut to what is left less 100, if over 200 are."""
    most = 4 * max_tokens
    head = F.format_string("### Reference %d: %s (%s/%s)\n", F.col("rank"), F.col("title"), F.col("topic"), F.col("subtopic"))
    block = F.concat(head, F.lit("**From: "), F.col("chapter"), F.lit("**\n\n"), F.col("shown"), F.lit("\n\n---"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("block", block).withColumn("upto", F.sum(F.length("block")).over(w)).withColumn("left", most - F.col("upto") + F.length("block"))
    over = F.row_number().over(Window.partitionBy("query_id", F.col("upto") > most).orderBy("rank"))
    rows = rows.withColumn("nth", over)
    short = F.concat(head, F.lit("\n"), F.expr("substring(shown, 1, cast(left - 100 as int))"), F.lit("...\n\n---"))
    part = F.when(F.col("upto") <= most, F.col("block")).when((F.col("nth") == 1) & (F.col("left") - 100 > 200), short)
    return rows.withColumn("part", part).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("rank", "part")))), lambda x: x["part"]), "\n\n").alias("context"))


def format_hits(hits: DataFrame, topic: str) -> DataFrame:
    """Hits whose topic holds ``topic``, ranked anew from 1."""
    rows = hits.where(F.contains(F.lower("topic"), F.lit(topic.lower())))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def append_citations(solutions: DataFrame, hits: DataFrame) -> DataFrame:
    """``solutions`` (query_id, explanation, formulas_used) with formulas listed as used, else up to
    three hits over 0.4, at the end of the explanation."""
    top = hits.where("score > 0.4").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("n <= 3")
    line = F.format_string("  • [%s] %s (relevance: %d%%)\n", F.coalesce("subtopic", "topic"), F.substring("content", 1, 200), F.bround(F.col("score") * 100).cast("int"))
    cited = top.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "").alias("cited"))
    rows = solutions.join(cited, "query_id", "left")
    used = F.concat(F.lit("\n\n📚 Formulas Used (from knowledge base):\n"), F.array_join(F.transform("formulas_used", lambda f: F.concat(F.lit("  • "), f)), "\n"))
    tail = F.when(F.size("formulas_used") > 0, used).when(F.col("cited").isNotNull(), F.concat(F.lit("\n\n📚 Related Formulas (from knowledge base):\n"), F.col("cited"))).otherwise("")
    return rows.withColumn("explanation", F.concat(F.coalesce("explanation", F.lit("")), tail)).drop("cited")


# --- reranking ----------------------------------------------------------------------------------
# Query types in order, with their content types' gains; topics with their words.
BOOSTS = {
    "how": {"example": 0.3, "solved_example": 0.4, "text": 0.1}, "what": {"definition": 0.4, "theorem": 0.3, "text": 0.2}, "prove": {"proof": 0.5, "theorem": 0.3, "theorem_statement": 0.2},
    "solve": {"solved_example": 0.4, "example": 0.3, "formula": 0.2}, "calculate": {"formula": 0.3, "solved_example": 0.3, "example": 0.2}, "find": {"formula": 0.3, "solved_example": 0.3, "example": 0.3},
    "define": {"definition": 0.5, "text": 0.2}, "explain": {"text": 0.3, "definition": 0.3, "example": 0.2},
}
QUERY_TOPICS = {
    "probability": ["probability", "chance", "likely", "odds", "random", "event", "sample space"], "calculus": ["derivative", "integral", "differentiate", "limit", "continuous"],
    "algebra": ["equation", "solve", "variable", "polynomial", "quadratic", "linear"], "statistics": ["mean", "median", "mode", "variance", "standard deviation", "distribution"],
    "geometry": ["angle", "triangle", "circle", "area", "perimeter", "volume"],
}


def query_type(query: Column) -> Column:
    low = F.lower(query)
    return F.coalesce(*(F.when(low.contains(t), F.lit(t)) for t in BOOSTS), F.lit("general"))


def query_topic(query: Column) -> Column:
    low = F.lower(query)
    return F.coalesce(*(F.when(has(low, "|".join(map(str, ws))), F.lit(t)) for t, ws in QUERY_TOPICS.items()), F.lit("general"))


def feature_score(query: Column, content_type: Column, topic: Column, title: Column) -> Column:
    low, kind = F.lower(query), query_type(query)
    gain = F.coalesce(*(F.when((kind == q) & (content_type == t), F.lit(g)) for q, ts in BOOSTS.items() for t, g in ts.items()), F.lit(0.0))
    shared = F.size(F.array_intersect(F.array_distinct(words(low)), words(F.lower(title))))
    score = 0.5 + gain + F.when(F.contains(F.lower(topic), query_topic(query)), 0.2).otherwise(0.0) + F.least(F.lit(0.2), shared * 0.05)
    return F.least(F.lit(1.0), score + F.when(has(low, r"\d") & content_type.isin("example", "solved_example"), 0.15).otherwise(0.0))


def hybrid_rerank(hits: DataFrame, k: int) -> DataFrame:
    """.5 cross + .2 semantic + .2 keyword + .1 features; the cross score of plain hits is 0."""
    cross = F.coalesce(F.col("cross"), F.lit(0.0)) if "cross" in hits.columns else F.lit(0.0)
    total = 0.5 * cross + 0.2 * F.col("semantic") + 0.2 * F.col("keyword") + 0.1 * feature_score(F.col("query"), F.col("content_type"), F.col("topic"), F.col("title"))
    return ranked(hits.drop("rank").withColumn("combined", F.round(total, 9)), F.col("combined"), k, "chunk_id")


def pair_text(title: Column, content: Column, most: int = 1500) -> Column:
    return F.substring(F.concat_ws(": ", title, content), 1, most)


def cross_rerank(hits: DataFrame, k: int, score: str = "pair_score") -> DataFrame:
    """A pair scorer's column scaled to 0..1 within each query (0.5 when all are equal, as it is for
    a single hit), .7 of it and .3 of the hit's own score."""
    w = Window.partitionBy("query_id")
    lo, hi, n = F.min(score).over(w), F.max(score).over(w), F.count("*").over(w)
    scaled = F.when(n == 1, F.col(score)).when(hi == lo, 0.5).otherwise((F.col(score) - lo) / (hi - lo))
    return ranked(hits.drop("rank").withColumn("combined", F.round(0.7 * scaled + 0.3 * F.col("score"), 9)), F.col("combined"), k, "chunk_id")


def maxsim(a: Column, b: Column) -> Column:
    """Mean over the vectors of ``a`` of the largest cosine with one of ``b``."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        def unit(v):
            m = np.array([np.asarray(r, np.float64) for r in v])
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

        return pd.Series([float((unit(s) @ unit(t).T).max(1).mean()) if len(s) and len(t) else 0.0 for s, t in zip(x, y)])

    return of(a, b)


def maxsim_rerank(hits: DataFrame, k: int) -> DataFrame:
    sim = maxsim(F.col("query_vectors"), F.col("doc_vectors"))
    rows = hits.drop("rank").withColumn("maxsim", sim).withColumn("combined", F.round(0.6 * F.col("maxsim") + 0.4 * F.col("score"), 6))
    return ranked(rows, F.col("combined"), k, "chunk_id")


def judge_score(reply: Column) -> Column:
    """The first number of a reply, 0 to 10, as 0 to 1; 0.5 without one."""
    number = F.regexp_extract(reply, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(number.isNotNull(), F.least(F.lit(10.0), number) / 10).otherwise(0.5)  # least passes over nulls


def judge_rerank(hits: DataFrame, replies: DataFrame, k: int) -> DataFrame:
    """Ranked by the judge's own score; combined is .6 of it and .4 of the hit's."""
    rows = hits.drop("rank").join(replies, ["query_id", "chunk_id"], "left").withColumn("judge", judge_score(F.col("reply")))
    return ranked(rows.withColumn("combined", F.round(0.6 * F.col("judge") + 0.4 * F.col("score"), 9)), F.col("judge"), k, "chunk_id")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 5, min_score: float = 0.25, topic: str | None = None, rerank: bool = True) -> DataFrame:
    """The whole search: 4k vector and keyword candidates (2k without reranking), fusion, dedup (half
    the score limit when reranked), reranking, score and quality limits, the first k.

    queries: query_id, query, embedding; chunks: chunk_id, pos, content, content_type, topic,
    subtopic, chapter, section, embedding."""
    from tutorlake.operators import keyword_scan  # which builds on this module

    wide = (4 if rerank else 2) * k
    vectors = kept(chunks.select("chunk_id", "embedding"))  # read twice, for its size and for the search
    near, keyed = vector_topk(queries, vectors, wide), keyword_scan.topk(queries, chunks, wide)
    rows = candidates(fuse(near, keyed), chunks.drop("embedding"), 3 * k, min_score / 2 if rerank else min_score, topic)
    hits = build_hits(rows, sections(chunks)).join(queries.select("query_id", "query"), "query_id")
    if rerank:
        hits = hybrid_rerank(hits, 2 * k)
    hits = hits.where((F.col("combined") >= min_score) & ~is_low_quality(F.col("shown")))
    return ranked(hits.drop("rank"), F.col("combined"), k, "chunk_id")


def expand(queries: DataFrame, lexicon: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(query_id, topic, terms, expanded): terms of every lexicon entry with a keyword in the query,
    without those that share a word with it, in lexicon order, at most ``most``.

    lexicon: pos, topic, keywords array, terms array - usually a few dozen rows; without one that of
    ``rules.EXPANSIONS``."""
    if lexicon is None:
        rows = [(i, *e) for i, e in enumerate(EXPANSIONS)]
        lexicon = queries.sparkSession.createDataFrame(rows, "pos int, topic string, keywords array<string>, terms array<string>")
    low = F.lower("query")
    rows = queries.join(lexicon, F.exists("keywords", lambda k: F.contains(low, F.lower(k))), "left")
    by = rows.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("pos", "topic", "terms")))).alias("found"))
    more = F.concat(
        F.flatten(F.transform("found", lambda x: x["terms"])),
        F.when(has(F.col("query"), r"\b52\b"), F.array(*map(F.lit, ("deck of cards", "standard deck", "playing cards")))).otherwise(F.array().cast("array<string>")),
        F.when(has(F.lower("query"), r"\b6\b.*\b(dice|die|sided)\b"), F.array(*map(F.lit, ("six-sided die", "fair dice")))).otherwise(F.array().cast("array<string>")),
    )
    own = words(F.lower("query"))
    terms = F.slice(F.filter(F.array_distinct(more), lambda t: ~F.arrays_overlap(F.split(F.lower(t), " "), own)), 1, most)
    by = by.withColumn("terms", terms)
    topic = F.coalesce(F.get("found", F.lit(0))["topic"], F.lit("general"))
    return by.select("query_id", topic.alias("topic"), "terms", F.when(F.size("terms") > 0, F.concat_ws(" ", "query", F.array_join("terms", " "))).otherwise(F.col("query")).alias("expanded"))
