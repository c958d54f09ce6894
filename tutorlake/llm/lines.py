"""Line dedup by a deletion-neighbourhood join, in DataFrame expressions alone.

A line (a piece of text between line feeds) is removed if an earlier one, by (key, line number)
over the whole table, equals it or is within one edit of it. The edit unit is the word (a piece
between single spaces) and both lines must have ``min_words`` words or more, so that lines of
five words or more that differ by one are at least 0.8 alike; shorter lines only count when
equal. Lines are judged on the input, not on what is left; blank lines are always kept.

1. Lines are hashed; a partial aggregation finds the first place of each distinct line.
2. One edit leaves one half of a line untouched. Hashes of the halves (for a line of n words, as
   seen by lines of n and of n - 1 words) find the lines that share a half with another one; all
   others, mostly nearly all of them, can have no near duplicate and go no further.
3. The rest emit their deletion neighbourhood beside each shared half: the other half with each
   word left out, hashed together with the shared one. Equal variants with the same word left out are substitutions of
   one another; a variant that equals an untouched line is one insertion away from it. Only the
   earliest line of a variant is looked at, by aggregation and join, so no pairs within a group
   are made, however often a line recurs.
4. Each line and its earliest partner are fetched and their edit distance is verified.

Null texts have one blank line. Rows with a null key keep all their lines. Rows that share a key
are one document: lines of equal number and text in both are one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorlake.llm.common import materialize, unused

MIN_WORDS = 5


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _ident(*parts: Column) -> Column:
    return F.struct(F.xxhash64(*parts).alias("h"), F.hash(*parts).alias("g"))


def _head(line: Column, n: Column) -> Column:
    """The first n words."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def _tail(line: Column, n: Column) -> Column:
    """The last n words; all of none is the empty string."""
    return F.call_function("substring_index", line, F.lit(" "), -n)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line), line numbers from 0."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return df.select(F.col(key).alias("doc_id"), F.posexplode(split).alias("line_no", "line"))


def _half_hash(side: int, size: Column, part: Column) -> Column:
    return F.xxhash64(F.lit(side), size.cast("int"), part)


def _halves(line: Column, n: Column, least: int) -> Column:
    """Hashes of the halves by which another line of n words (m = n), or one of fewer or more
    words (m the smaller count), would know this line."""
    out = []
    for m in (n, n - 1):
        h = _half(m)
        for side, part, size in ((0, _head(line, h), h), (1, _tail(line, m - h), m - h)):
            out.append(F.when(m >= least, _half_hash(side, size, part)))
    return F.array_compact(F.array_distinct(F.array(*out)))


def _distinct(df: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Every line that is not blank, hashed, and each distinct line with its first place."""
    line, n = F.col("line"), F.col("n")
    every = lines(df, key, text).where((F.trim("line") != "") & F.col("doc_id").isNotNull()).select("doc_id", "line_no", _ident(line).alias("id"), _n_words(line).alias("n"), "line")
    every = every.select("doc_id", "line_no", "id", F.when(n >= least, _halves(line, n, least)).alias("halves"))
    every = materialize(every.select("doc_id", "line_no", "id", *(F.get("halves", F.lit(i)).alias(f"k{i}") for i in range(4))))
    first = every.groupBy("id", "k0", "k1", "k2", "k3").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times"))
    return every, materialize(first)


def _sharing(first: DataFrame) -> DataFrame:
    """(doc_id, line_no, halves): first places of the distinct lines that share a half with another
    one, and the halves that are shared."""
    keys = first.select("id", "first", F.explode(F.array_compact(F.array("k0", "k1", "k2", "k3"))).alias("half"))
    w = Window.partitionBy("half").orderBy("id")
    keys = keys.select("first", "half", F.lag("first").over(w).alias("one"), F.lead("first").over(w).alias("other"))
    shared = keys.where("one is not null or other is not null").select("first.doc_id", "first.line_no", "half")
    return shared.groupBy("doc_id", "line_no").agg(F.collect_set("half").alias("halves"))


def _variants(near: DataFrame, least: int) -> DataFrame:
    """(key, whole, place): the neighbourhood of each line; ``whole`` marks the untouched lines."""
    line, n = F.col("line"), F.col("n")

    def of(side: int, m: Column, kind: int) -> Column:
        """The part of the line beside the half that ``side`` keeps, with words left out or not."""
        h = _half(m)
        kept = _head(line, h) if side == 0 else _tail(line, m - h)
        size = n - h if side == 0 else n - (m - h)
        rest = _tail(line, size) if side == 0 else _head(line, size)
        shared = F.array_contains("halves", _half_hash(side, h if side == 0 else m - h, kept))
        start = F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), m.cast("int").alias("m"), _ident(kept).alias("kept"), rest.alias("rest"), size.cast("int").alias("size"))
        return F.when((m >= least) & shared, start)

    parts = F.array_compact(F.array(*(of(side, m, kind) for side in (0, 1) for m, kind in ((n, 0), (n, 1), (n - 1, 2)))))
    each = near.select("place", F.explode(parts).alias("p")).select("place", "p.*")
    # kind 0: substitution, 1: untouched, 2: deletion; the last one's halves are those of n - 1 words
    word = F.when(F.col("kind") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("size")))
    each = each.where("size > 0 or kind = 1").select("*", F.explode(word).alias("i"))
    left = F.when(F.col("kind") == 1, F.struct(F.col("rest").alias("a"), F.lit("").alias("b"))).otherwise(
        F.struct(_head(F.col("rest"), F.col("i") - 1).alias("a"), F.when(F.col("i") < F.col("size"), _tail(F.col("rest"), F.col("size") - F.col("i"))).otherwise("").alias("b"))
    )
    each = each.select("*", left.alias("left"))
    # words may be empty, so counts tell whether there is a part on either side, not the strings
    ends = (F.col("kind") == 1) | (F.col("i") == 1) | (F.col("i") == F.col("size"))
    joined = F.when(ends, F.concat("left.a", "left.b")).otherwise(F.concat_ws(" ", "left.a", "left.b"))
    # an insertion may leave nothing of a half, or one empty word: the count of words tells them apart
    count = F.when(F.col("kind") == 1, F.col("size")).otherwise(F.col("size") - 1)
    where = F.when(F.col("kind") == 0, F.col("i")).otherwise(F.lit(0))
    return each.select(_ident(F.col("kind") > 0, "side", "m", "kept", count, where, joined).alias("key"), (F.col("kind") == 1).alias("whole"), (F.col("kind") == 0).alias("swap"), "place")


def near_duplicates(first: DataFrame, df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(doc_id, line_no, by): first places of lines with an earlier line one edit away."""
    at = _sharing(first)
    asked = at.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "halves")).alias("wanted"))
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(asked, "doc_id")
    found = docs.select("doc_id", F.inline("wanted"), split.alias("all")).select("doc_id", "line_no", "halves", F.get("all", F.col("line_no")).alias("line"))
    near = found.where("line is not null").select(F.struct("doc_id", "line_no").alias("place"), "line", "halves", _n_words(F.col("line")).cast("int").alias("n"))
    near = materialize(near.where(F.col("n") >= least).dropDuplicates(["place"]))
    rows = _variants(near, least)
    low = rows.groupBy("key").agg(F.min(F.when(F.col("whole") | F.col("swap"), F.col("place"))).alias("plain"), F.min(F.when(~F.col("whole") & ~F.col("swap"), F.col("place"))).alias("cut"), F.count("*").alias("c"))
    met = rows.join(low.where("c > 1"), "key")
    by = F.when(F.col("whole"), F.col("cut")).otherwise(F.col("plain"))  # swap and cut look at plain, untouched at cut
    met = met.select("place", by.alias("by")).where("by < place").distinct()
    texts = near.select("place", "line")
    pairs = met.join(texts, "place").join(texts.select(F.col("place").alias("by"), F.col("line").alias("other")), "by")
    return pairs.where(within_one_edit(F.col("line"), F.col("other"))).groupBy("place").agg(F.min("by").alias("by")).select("place.doc_id", "place.line_no", "by")


def within_one_edit(a: Column, b: Column) -> Column:
    """Edit distance in words is 0 or 1: equal words from the front and from the back make up all
    words but one of the longer line."""
    x, y = F.split(a, " "), F.split(b, " ")
    n = F.greatest(F.size(x), F.size(y))
    first_other = lambda p, q: F.coalesce(F.nullif(F.array_position(F.zip_with(p, q, lambda s, t: s.eqNullSafe(t)), False), F.lit(0)), n + 1) - 1
    return (first_other(x, y) + first_other(F.reverse(x), F.reverse(y)) >= n - 1) & (F.abs(F.size(x) - F.size(y)) <= 1)


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, near, by): each line to remove and the earlier line (doc_id, line_no)
    that it repeats; ``near`` tells edits from equal lines."""
    every, first = _distinct(df, key, text, min_words)
    again = first.where("times > 1").select("id", "first")
    equal = every.select("doc_id", "line_no", "id").join(again, "id").where(F.struct("doc_id", "line_no") != F.col("first")).select("doc_id", "line_no", F.lit(False).alias("near"), F.col("first").alias("by"))
    near = near_duplicates(first, df, key, text, min_words).select("doc_id", "line_no", F.lit(True).alias("near"), "by")
    return equal.unionByName(near)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the removed lines taken out of ``text``; a text that loses all lines is empty,
    a null text stays null. All rows and other columns stay."""
    own, lost = unused(df, "key_of_lost"), unused(df, "lost")
    gone = removed(df, key, text, min_words).groupBy("doc_id").agg(F.collect_set("line_no").alias(lost)).withColumnRenamed("doc_id", own)
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    got = df.join(gone, F.col(key) == F.col(own), "left")
    return got.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept)).select(*df.columns)


def report(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: number of lines, how many of them equal or nearly equal an earlier one, which."""
    gone = removed(df, key, text, min_words).groupBy("doc_id").agg(F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.array_join(F.sort_array(F.collect_list("line_no")), ",").alias("removed"))
    size = F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("long")
    got = df.select(F.col(key).alias("doc_id"), size.alias("n_lines")).join(gone, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return got.select("doc_id", "n_lines", zero("n_equal"), zero("n_near"), F.coalesce("removed", F.lit("")).alias("removed"))
