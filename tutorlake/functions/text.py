"""Column helpers for text: all JVM-side expressions, Unicode classes as in the rules they state."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rx(pattern: str) -> str:
    """``\\w``, ``\\d``, ``\\s`` and ``\\b`` over all of Unicode."""
    return "(?U)" + pattern


#: A pattern that begins with a word or a group of words, neither of them repeated.
_WORDS_FIRST = re.compile(r"(?:\\b)?(?:\((?:\?:)?(?P<group>(?:[a-z ?|-]|\\s\+)+)\)|(?P<word>[a-z]+))(?P<rest>(?:\\[bs].*)?)")


def clues(pattern: str) -> list[str]:
    """Strings of which every match of the pattern holds one; empty where its form does not tell."""
    m = _WORDS_FIRST.fullmatch(pattern)
    if not m or "|" in re.sub(r"\([^()]*\)", "", m["rest"]):
        return []
    parts = [re.sub(r".\?.*|\\.*", "", w) for w in (m["group"] or m["word"]).split("|")]
    return parts if min(map(len, parts)) > 1 else []


#: Tells of a pattern whether it needs to be tried on a row (see ``prefilter``), null if always.
Gate = Callable[[str], Column | None]


def has(text: Column, pattern: str, gate: Gate | None = None) -> Column:
    """Whether the pattern occurs; where ``gate``, or words without one, tell that it cannot, it is not tried."""
    found = text.rlike(rx(pattern))
    if gate is not None:
        may = gate(pattern)
        return found if may is None else may & found
    return contains_any(text, words_in) & found if (words_in := clues(pattern)) else found


def may_any(patterns, gate: Gate) -> Column:
    """Whether one of the patterns needs to be tried."""
    tests = [gate(p) for p in patterns]
    return F.lit(True) if any(t is None for t in tests) else reduce(Column.__or__, tests)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rx(r"^\s+|\s+$"), "")


def squeeze(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, rx(r"\s+"), " "))


def chain(text: Column, rules) -> Column:
    """Replace pattern after pattern; a rule is (pattern, replacement)."""
    return reduce(lambda c, r: F.regexp_replace(c, rx(r[0]), r[1]), rules, text)


def count_hits(text: Column, patterns, gate: Gate | None = None) -> Column:
    """How many of the patterns occur."""
    return reduce(Column.__add__, (has(text, p, gate).cast("int") for p in patterns), F.lit(0))


def first_label(text: Column, rules, gate: Gate | None = None) -> Column:
    """The label of the first pattern that occurs, in the order given; null if none does."""
    return F.coalesce(*(F.when(has(text, p, gate), F.lit(label)) for p, label in rules))


def all_labels(text: Column, rules) -> Column:
    """The labels of all patterns that occur, in the order given."""
    return F.array_compact(F.array(*(F.when(has(text, p), F.lit(label)) for p, label in rules)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: what a generator makes is not copied into the
    filters and expressions that read it later, as plain projections are, which for a chain of costly
    columns would double the work with every step."""
    made = F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.select(*(F.col(c) for c in df.columns if c not in columns), made)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(text, rx(r"\s+")), lambda w: w != "")


def contains_any(text: Column, parts) -> Column:
    return reduce(Column.__or__, (text.contains(p) for p in parts), F.lit(False))


def count_contained(text: Column, parts) -> Column:
    return reduce(Column.__add__, (text.contains(p).cast("int") for p in parts), F.lit(0))
