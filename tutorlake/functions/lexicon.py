"""Topic lexicon: topic, subtopic and keywords, in order of precedence.

A lexicon is a parameter: a list, a table (``from_table``) or a text file (``from_file``); the
default is the file beside this module. One automaton finds all keywords in one pass over a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tutorlake.functions.text import once, unused


def from_file(path: str | Path) -> list[tuple[str, str, list[str]]]:
    """The lexicon in a file of lines ``topic | subtopic | keyword, keyword``; # begins a remark."""
    lines = [x for x in Path(path).read_text("utf-8").splitlines() if x.strip() and not x.startswith("#")]
    split = lambda s, by: [x.strip() for x in s.split(by)]
    return [(topic, subtopic, split(keys, ",")) for topic, subtopic, keys in (re.split(r"\s+\|\s+", x, maxsplit=2) for x in lines)]


DEFAULT = from_file(Path(__file__).with_name("topics.txt"))


def from_table(rows: DataFrame, most: int = 5_000) -> list[tuple[str, str, list[str]]]:
    """The lexicon in a table (pos, topic, subtopic, keywords array<string>), in order of ``pos``. As it
    becomes part of an expression, a table of more than ``most`` rows is refused."""
    got = rows.select("pos", "topic", "subtopic", "keywords").orderBy("pos").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a lexicon of more than {most} rows")
    return [(r["topic"], r["subtopic"], list(r["keywords"] or ())) for r in got]


@lru_cache(16)
def _judge(keywords: tuple[tuple[str, ...], ...]):
    """A function of lower-case texts: the place of the entry with most of its keywords in a text, the
    first of equals, -1 if none occurs. One automaton finds all keywords in one pass."""
    entries = {}
    for i, keys in enumerate(keywords):
        for k in keys:
            entries.setdefault(k.lower(), []).append(i)
    words, n = sorted(entries), len(keywords)

    @F.pandas_udf(IntegerType())
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, w in enumerate(words):
            found.add_word(w, i)
        found.make_automaton()
        for texts in batches:
            out = np.full(len(texts), -1, np.int32)
            for row, t in enumerate(texts):
                seen = {i for _, i in found.iter(t)} if isinstance(t, str) and words else ()
                if seen:
                    out[row] = np.bincount([e for i in seen for e in entries[words[i]]], minlength=n).argmax()
            yield pd.Series(out)

    return judge


def _best(low: Column, lexicon) -> Column:
    place = _judge(tuple(tuple(keys) for _, _, keys in lexicon))(low)
    names = [F.struct(F.lit(t).alias("topic"), F.lit(s).alias("subtopic")) for t, s, _ in [("general", "miscellaneous", ()), *lexicon]]
    return F.get(F.array(*names), place + 1)


def classify(text: Column, lexicon=None) -> Column:
    """struct<topic, subtopic>: of the subtopic with most keywords in the text (as substrings, any
    case), the earlier of equals; general / miscellaneous if none occurs."""
    return _best(F.lower(text), lexicon or DEFAULT)


def with_topic(df: DataFrame, text: Column, lexicon=None) -> DataFrame:
    """``df`` with topic and subtopic of ``text`` by ``classify``, the text lowered and judged once a row."""
    best = unused(df, "best_topic")
    df = once(df, **{best: _best(F.lower(text), lexicon or DEFAULT)})
    return df.withColumns({"topic": F.col(f"{best}.topic"), "subtopic": F.col(f"{best}.subtopic")}).drop(best)
