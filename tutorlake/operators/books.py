"""From pages of books to typed passages, and from passages to chunks with topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tutorlake.functions import lexicon
from tutorlake.functions.text import has, once, rx, strip, words
from tutorlake.operators import segments

# How headings, passages, formulas and solutions begin and end.
CHAPTER = r"(?mi)^Chapter\s*(\d+)\s*[:\-]?\s*(.+?)$"
SECTION = r"(?m)^(\d+\.\d+)\s+(.+?)$"
_NUMBER = r"\s*(?:\d+(?:\.\d+)?)?[:.]?\s*(.*?)"
DEFINITION = rf"(?is)Definition{_NUMBER}(?=Definition|Theorem|Example|Proof|\z)"
THEOREM = rf"(?is)Theorem{_NUMBER}(?=Definition|Theorem|Example|Proof|Corollary|\z)"
EXAMPLE = rf"(?is)Example{_NUMBER}(?=Example|Exercise|Try It|Definition|Theorem|\z)"
FORMULAS = [("latex_inline", r"\$([^$]+)\$", 1), ("latex_display", r"\$\$([^$]+)\$\$", 1), ("expression", r"(?:[a-zA-Z]\s*=\s*[^,.\n]+)|(?:\d+[a-zA-Z]\s*[+\-]\s*\d+)|(?:[∫∑∏√∞≤≥≠±×÷∂∇∈∉⊂⊃∪∩])", 0)]
SOLUTION = [r"(?i)Solution[:.]", r"(?i)Answer[:.]", r"(?i)Solve[:.]", r"(?i)We have", r"(?i)Let us", r"(?i)First,", r"(?i)Step 1"]
PROOF = ["Proof:", "Proof.", "PROOF"]
STEP = r"(?i)(Step\s*\d+[:.]|First[,:]|Second[,:]|Then[,:]|Finally[,:]|Therefore[,:])"
MAX_CHUNK = 1000
#: Pages of a range in which pages and chapters meet.
PAGES = 64


# --- pages --------------------------------------------------------------------------------------
def chapter_headings(pages: DataFrame) -> DataFrame:
    """(book, page_idx, chapter_no, title) of pages with a chapter heading, the first on each."""
    got = pages.select("book", "page_idx", F.regexp_extract("text", rx(CHAPTER), 1).alias("no"), strip(F.regexp_extract("text", rx(CHAPTER), 2)).alias("title"))
    return got.where("no <> ''").select("book", "page_idx", F.col("no").try_cast("bigint").alias("chapter_no"), "title")


def chapter_ranges(heads: DataFrame, pages_of: DataFrame) -> DataFrame:
    """(book, pos, chapter_no, title, start_page, end_page) from heads (book, pos, title, page) and
    (book, total): a chapter ends on the page before the next begins, the last on the last page."""
    rows = segments.scan(heads, ["book"], "pos", following={"next": F.col("page")}, number="nth")
    number = F.coalesce(F.nullif(F.regexp_extract("title", r"(\d+)", 1), F.lit("")).try_cast("bigint"), F.col("nth"))
    rows = rows.select("book", "pos", "title", F.col("page").alias("start_page"), number.alias("chapter_no"), "next")
    return rows.join(pages_of, "book").select("book", "pos", "chapter_no", "title", "start_page", F.coalesce(F.col("next") - 1, F.col("total")).alias("end_page"))


def outline_sections(toc: DataFrame) -> DataFrame:
    """(book, chapter_pos, sections) of outline rows (book, pos, level, title, page): level 2 belongs
    to the level 1 before it; without one it is dropped."""
    rows = segments.scan(toc, ["book"], "pos", last={"chapter_pos": F.when(F.col("level") == 1, F.col("pos"))}).where("level = 2 and chapter_pos is not null")
    return rows.groupBy("book", "chapter_pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "title", "page"))), lambda x: F.struct(x["title"].alias("title"), x["page"].alias("page"))).alias("sections"))


def pages_in_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Pages with each chapter that holds them (book, page_idx from start to end, total excluded). Both
    sides meet by book and range of PAGES pages; a chapter comes once for each range it reaches."""
    total = pages.groupBy("book").agg((F.max("page_idx") + 1).alias("total"))
    c = chapters.join(total, "book").withColumn("stop", F.least(F.col("end_page") + 1, F.col("total"))).where(F.col("start_page") < F.col("stop"))
    reach = F.sequence(F.floor(F.col("start_page") / PAGES), F.floor((F.col("stop") - 1) / PAGES))
    c = c.select("book", F.col("pos").alias("chapter_pos"), F.col("title").alias("chapter"), "start_page", "stop", F.explode(reach).alias("pages_range"))
    both = pages.withColumn("pages_range", segments.range_of("page_idx", PAGES)).join(c, ["book", "pages_range"])
    return both.where((F.col("page_idx") >= F.col("start_page")) & (F.col("page_idx") < F.col("stop"))).drop("pages_range", "start_page", "stop")


def carry_section(pages: DataFrame) -> DataFrame:
    """``pages`` (book, chapter_pos, page_idx, text) with the section that holds on each page: the
    last heading up to it within the chapter, 'Introduction' before the first."""
    own = F.when(has(F.col("text"), SECTION), F.concat_ws(" ", F.regexp_extract("text", rx(SECTION), 1), strip(F.regexp_extract("text", rx(SECTION), 2))))
    return segments.scan(pages, ["book", "chapter_pos"], "page_idx", last={"section": own}).fillna("Introduction", ["section"])


def formulas(text: Column) -> Column:
    """array<struct<type, content>> of the three kinds; a text may be found by several."""

    def of(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(rx(pattern)), group), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("content")))

    return F.concat(*(of(*f) for f in FORMULAS))


def _passages(pages: DataFrame, pattern: str, least: int) -> DataFrame:
    rows = pages.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(rx(pattern)), 1)).alias("nth", "raw"))
    return rows.withColumn("content", strip(F.col("raw"))).where(F.length("content") > least).drop("raw", "text")


def extract_definitions(pages: DataFrame) -> DataFrame:
    return _passages(pages, DEFINITION, 20).withColumn("title", definition_title(F.col("content")))


def extract_theorems(pages: DataFrame) -> DataFrame:
    return _passages(pages, THEOREM, 20).withColumn("title", theorem_title(F.col("content")))


def extract_examples(pages: DataFrame) -> DataFrame:
    return _passages(pages, EXAMPLE, 50).withColumn("split", split_example(F.col("content"))).select("*", "split.problem", "split.solution").drop("split")


def split_example(text: Column) -> Column:
    """struct<problem, solution>: at the first marker, in the order of the list, that occurs; else
    after the first paragraph; else all of it is the problem."""

    def at(marker: str) -> Column:
        i = F.regexp_instr(text, F.lit(rx(marker)))
        return F.when(i > 0, F.struct(strip(F.substring(text, F.lit(1), i - 1)).alias("problem"), strip(F.substring(text, i, F.length(text))).alias("solution")))

    parts = F.split(text, "\n\n")
    rest = F.struct(F.get(parts, F.lit(0)).alias("problem"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "\n\n").alias("solution"))
    return F.coalesce(*map(at, SOLUTION), rest)


def definition_title(text: Column) -> Column:
    named = F.regexp_extract(text, rx(r"^(?:A|An|The)\s+(\w+(?:\s+\w+)?)"), 1)
    return F.when(named != "", F.initcap(named)).otherwise(F.array_join(F.slice(words(text), 1, 3), " "))


def theorem_title(text: Column) -> Column:
    named = F.regexp_extract(text, rx(r"(?i)(\w+(?:'s)?)\s+(?:Theorem|Rule|Formula|Law)"), 0)
    first = F.substring_index(text, ".", 1)
    return F.when(named != "", named).when(F.length(first) < 100, first).otherwise("Theorem")


def book_type(pages: DataFrame, name: str = "openstax", first: int = 10) -> DataFrame:
    return pages.where(F.col("page_idx") < first).groupBy("book").agg(F.bool_or(F.contains(F.lower("text"), F.lit(name))).alias("is_known"))


def book_summary(pages: DataFrame, chapters: DataFrame, passages: DataFrame) -> DataFrame:
    """(book, pages, chapters, definitions, theorems, examples, formulas)."""
    kinds = ("definition", "theorem", "example", "formula")
    by = passages.groupBy("book").agg(*(F.count_if(F.col("content_type") == k).alias(f"{k}s") for k in kinds))
    got = pages.groupBy("book").agg(F.count("*").alias("pages")).join(chapters.groupBy("book").agg(F.count("*").alias("chapters")), "book", "left").join(by, "book", "left")
    return got.fillna(0, ["chapters", *(f"{k}s" for k in kinds)])


# --- chunks -------------------------------------------------------------------------------------
def chunk_id(source: Column, page: Column, content: Column) -> Column:
    """First 12 hex digits of the md5 of source, page and the first 50 characters."""
    return F.substring(F.md5(F.concat_ws("_", F.coalesce(source, F.lit("")), F.coalesce(page.cast("string"), F.lit("")), F.substring(content, 1, 50))), 1, 12)


def pack_sentences(text: Column, most: int = MAX_CHUNK) -> Column:
    """Sentences packed into parts of ``most`` characters; a longer sentence is a part of its own.
    Only lengths of sentences go to Python, which tells where each part begins; linear in the text."""
    sentences = F.split(text, rx(r"(?<=[.!?])\s+"))
    both = F.array(F.struct(sentences.alias("s"), _cuts(F.transform(sentences, F.length), F.lit(most)).alias("cuts")))  # split once, not for each part
    parts = F.transform(both, lambda x: F.transform(x["cuts"], lambda c: strip(F.array_join(F.slice(x["s"], c["at"], c["n"]), " "))))
    return F.get(parts, F.lit(0))


@F.pandas_udf(ArrayType(StructType([StructField("at", IntegerType()), StructField("n", IntegerType())])))
def _cuts(lengths: pd.Series, most: pd.Series) -> pd.Series:
    """First sentence (from 1) and number of sentences of each part. Each sentence takes a place
    more than its length; the end of a part is looked up in the running sums."""

    def of(sizes, limit):
        if sizes is None:
            return None
        upto, out, i = np.cumsum(np.asarray(sizes, np.int64) + 1), [], 0
        while i < len(upto):
            j = max(i + 1, int(np.searchsorted(upto, limit + 1 + (upto[i - 1] if i else 0), "right")))
            out.append({"at": i + 1, "n": j - i})
            i = j
        return out

    return pd.Series([of(s, m) for s, m in zip(lengths, most)], dtype=object)


def split_steps(text: Column) -> Column:
    """Steps of a solution: at step words; if there is at most one, paragraphs; else all of it."""
    marked = F.filter(F.transform(F.split(F.regexp_replace(text, rx(STEP), "\u0001$1"), "\u0001"), strip), lambda s: s != "")
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda s: s != "")
    return F.when(F.size(marked) > 1, marked).when(F.size(paragraphs) > 0, paragraphs).otherwise(F.array(text))


#: What only chunks of some kinds have, with its type.
EXTRAS = {"part": "int", "total_parts": "int", "has_proof": "boolean", "theorem_title": "string", "problem_only": "string", "solution_only": "string", "step_number": "int", "total_steps": "int", "raw_formula": "string", "formula_type": "string"}


def _piece(part_of: int, kind: str, body: Column, ident: Column, topic_of: Column | None = None, **extra: Column) -> Column:
    """A chunk as a struct; ``topic_of`` is the text that tells its topic where that is not the passage's."""
    none = F.lit(None)
    fields = [F.lit(part_of).alias("part_of"), F.lit(kind).alias("content_type"), body.alias("body"), ident.alias("ident"), (none if topic_of is None else topic_of).cast("string").alias("topic_of")]
    return F.struct(*fields, *(extra.get(k, none).cast(t).alias(k) for k, t in EXTRAS.items()))


def _if(condition: Column, *pieces: Column) -> Column:
    """An array of the pieces where the condition holds, else null."""
    return F.when(condition, F.array(*pieces))


def _long(part_of: int, kind: str) -> Column:
    """Content over the limit: its parts (column ``parts``), labelled one by one."""

    def one(piece, i):
        label = F.format_string(f"{kind.capitalize()} (Part %d/%d):\n\n%s", i + 1, F.size("parts"), piece)
        return _piece(part_of, kind, label, piece, part=i + 1, total_parts=F.size("parts"))

    return F.transform("parts", one)


def _definitions() -> list[Column]:
    whole = F.format_string("Definition: %s\n\n%s", F.col("title"), F.col("content"))
    return [_if(F.length("content") <= MAX_CHUNK, _piece(0, "definition", whole, F.col("content"))), _long(0, "definition")]


def _theorems() -> list[Column]:
    """A statement (any length) and a proof (left out over the limit) where a proof marker occurs,
    the first of the list in its order; else whole or packed."""
    title, content, statement, proof = (F.col(c) for c in ("title", "content", "statement", "proof"))
    said, shown, marked = strip(statement), strip(proof), proof.isNotNull()
    whole = _piece(1, "theorem", F.format_string("Theorem: %s\n\n%s", title, content), content)
    return [
        _if(marked & (said != ""), _piece(1, "theorem_statement", F.format_string("Theorem: %s\n\nStatement: %s", title, said), statement, has_proof=shown != "")),
        _if(marked & (shown != "") & (F.length(proof) <= MAX_CHUNK), _piece(1, "proof", F.format_string("Proof of %s:\n\n%s", title, shown), proof, theorem_title=title)),
        _if(~marked & (F.length(content) <= MAX_CHUNK), whole),
        F.when(~marked, _long(1, "theorem")),
    ]


def _examples() -> list[Column]:
    """Problem and solution together if they fit, else a chunk for each step with the problem again;
    steps that do not fit are left out. Without both parts plain or packed."""
    content, problem, solution, joined = (F.col(c) for c in ("content", "problem", "solution", "joined"))

    def step(text, i):
        body = F.format_string("Problem:\n%s\n\nSolution Step %d:\n%s", problem, i + 1, text)
        return _piece(2, "solved_example_step", body, body, step_number=i + 1, total_steps=F.size("steps"))

    return [
        _if(F.length(joined) <= MAX_CHUNK, _piece(2, "solved_example", joined, joined, problem_only=problem, solution_only=solution)),
        F.filter(F.transform("steps", step), lambda x: F.length(x["body"]) <= MAX_CHUNK),
        _if(joined.isNull() & (F.length(content) <= MAX_CHUNK), _piece(2, "example", F.concat(F.lit("Example:\n"), content), content)),
        F.when(joined.isNull(), _long(2, "example")),
    ]


def _formula_pieces() -> list[Column]:
    chapter = F.coalesce("chapter", F.lit(""))

    def one(f):
        body = F.format_string("Formula: %s\n\nContext: Found in %s, \n\nType: %s", f["content"], chapter, f["type"])
        return _piece(3, "formula", body, f["content"], F.concat_ws(" ", f["content"], chapter), raw_formula=f["content"], formula_type=f["type"])

    return [F.transform("formulas", one)]


def _prepared(rows: DataFrame, kinds: set[str]) -> DataFrame:
    """``rows`` with what the pieces of these kinds are made of, each column computed once."""
    content = F.col("content")
    made = {}
    if kinds & {"definition", "theorem", "example"}:
        made["parts"] = F.when(F.length(content) > MAX_CHUNK, pack_sentences(content))
    if "theorem" in kinds:
        at = F.coalesce(*(F.when(F.contains(content, F.lit(m)), F.locate(m, content)) for m in PROOF))
        made["statement"], made["proof"] = F.substring(content, F.lit(1), at - 1), F.substring(content, at, F.length(content))
    if "example" in kinds:
        both = (F.coalesce("problem", F.lit("")) != "") & (F.coalesce("solution", F.lit("")) != "")
        made["joined"] = F.when(both, F.format_string("Problem:\n%s\n\nSolution:\n%s", F.col("problem"), F.col("solution")))
        made["steps"] = F.when(F.length(made["joined"]) > MAX_CHUNK, split_steps(F.col("solution")))
    return once(rows, **made) if made else rows


#: The kinds of passages, with the pieces of each; formulas stand in an array beside a passage.
KINDS = {"definition": _definitions, "theorem": _theorems, "example": _examples, "formula": _formula_pieces}


def chunk_passages(rows: DataFrame, *kinds: str) -> DataFrame:
    """Chunks of passages (passage_id, source, page_number, chapter, section, title, content, with
    problem and solution for examples and an array ``formulas`` of (type, content)), with ``part_of``
    0 to 3 for the kind. One pass: all pieces of a passage are an array made by one expression.
    Where ``rows`` has an array ``kinds``, a passage is taken for those of ``kinds`` alone.

    The topic is that of the passage, judged once, or that of the formula and its chapter; formula
    chunks have page 0 and no section."""
    kinds = kinds or tuple(KINDS)
    held = lambda k, c: F.when(F.array_contains("kinds", k), c) if "kinds" in rows.columns and k != "formula" else c
    rows = _prepared(lexicon.with_topic(rows, F.col("content")) if set(kinds) - {"formula"} else rows.withColumns({"topic": F.lit(None).cast("string"), "subtopic": F.lit(None).cast("string")}), set(kinds))
    pieces = [F.coalesce(held(k, c), F.array().cast(_PIECES)) for k in kinds for c in KINDS[k]()]
    keep = [F.col(c) for c in ("passage_id", "source", "page_number", "chapter", "section")]
    found = rows.select(*keep, F.col("topic").alias("own_topic"), F.col("subtopic").alias("own_subtopic"), F.inline(F.flatten(F.array(*pieces))))
    if "formula" in kinds:
        found = lexicon.with_topic(found, F.col("topic_of"))
        found = found.withColumns({c: F.when(F.col("topic_of").isNull(), F.col(f"own_{c}")).otherwise(F.col(c)) for c in ("topic", "subtopic")})
    else:
        found = found.withColumnsRenamed({"own_topic": "topic", "own_subtopic": "subtopic"})
    formula = F.col("content_type") == "formula"
    page = F.when(formula, 0).otherwise(F.col("page_number")) if "formula" in kinds else F.col("page_number")
    section = F.when(formula, "").otherwise(F.col("section")) if "formula" in kinds else F.col("section")
    return found.select(
        "passage_id", chunk_id(F.col("source"), page, F.col("ident")).alias("chunk_id"), F.col("body").alias("content"), "content_type", "topic", "subtopic", "source", page.alias("page_number"), "chapter", section.alias("section"), "part_of", *EXTRAS,
    )


_PIECES = "array<struct<part_of:int,content_type:string,body:string,ident:string,topic_of:string," + ",".join(f"{k}:{t}" for k, t in EXTRAS.items()) + ">>"


def _only(rows: DataFrame, kind: str, *extras: str) -> DataFrame:
    return chunk_passages(rows, kind).drop("part_of", *(k for k in EXTRAS if k not in extras))


def chunk_definitions(rows: DataFrame) -> DataFrame:
    return _only(rows, "definition", "part", "total_parts")


def chunk_theorems(rows: DataFrame) -> DataFrame:
    return _only(rows, "theorem", "part", "total_parts", "has_proof", "theorem_title")


def chunk_examples(rows: DataFrame) -> DataFrame:
    return _only(rows, "example", "part", "total_parts", "problem_only", "solution_only", "step_number", "total_steps")


def chunk_formulas(rows: DataFrame) -> DataFrame:
    """Rows (passage_id, source, chapter, type, content): a chunk with its context, page 0, no section."""
    rows = rows.withColumns({"formulas": F.array(F.struct("type", "content")), "page_number": F.lit(0), "section": F.lit("")})
    return _only(rows, "formula", "raw_formula", "formula_type")


def bucket(content_type: Column) -> Column:
    return F.when(content_type.contains("definition"), "definitions").when(content_type.contains("theorem") | content_type.contains("proof"), "theorems").when(content_type.contains("example"), "examples").when(content_type.contains("formula"), "formulas")


def topic_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with their bucket of the topic document; others drop out. At scale these rows are the
    document: written partitioned by topic (``sources.tables.write_topics``)."""
    return chunks.withColumn("bucket", bucket(F.col("content_type"))).where("bucket is not null")


def topic_counts(chunks: DataFrame) -> DataFrame:
    return topic_rows(chunks).groupBy("topic", "subtopic", "bucket").agg(F.count("*").alias("n"))


def kb_stats(chunks: DataFrame) -> DataFrame:
    """(metric, name, n) by topic, type and source and in all, one pass of grouping sets."""
    sets = chunks.groupingSets([["topic"], ["content_type"], ["source"], []], "topic", "content_type", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    metric = F.when(F.col("g") == 3, "topic").when(F.col("g") == 5, "content_type").when(F.col("g") == 6, "source").otherwise("total")
    return sets.select(metric.alias("metric"), F.coalesce("topic", "content_type", "source", F.lit("")).alias("name"), "n")


def latest_by_id(chunks: DataFrame, order: str = "pos") -> DataFrame:
    """One row of each chunk id, the last."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc(order))
    return chunks.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def kb_metadata(chunks: DataFrame) -> DataFrame:
    """One row: chunks, topics, types, size of the vectors."""
    dim = F.max(F.size("embedding")) if "embedding" in chunks.columns else F.lit(0)
    return chunks.agg(F.count("*").alias("total"), F.sort_array(F.collect_set("topic")).alias("topics"), F.sort_array(F.collect_set("content_type")).alias("types"), dim.alias("dim"))
