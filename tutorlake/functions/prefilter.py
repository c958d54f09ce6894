"""One automaton over the literals of many patterns, run once a text, that tells which patterns need to be tried.

From a pattern's syntax tree follow strings of which each match must hold one, usually several such
groups ("how" and one of "many", "much"). Strings that must stand as whole words are looked up among
the words of a text, single characters among its characters; all others, of all patterns, go into one
Aho-Corasick automaton. A pass over a text gives a bit for each string. A pattern is tried only on texts
whose bits meet every one of its groups. That a group is met proves nothing; that one is not met
proves that the pattern does not occur. So results are those of the patterns alone.

Texts and strings are compared in lower case, with the characters folded that case-blind
patterns take for ASCII letters, so one pass serves patterns on a text and on its lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that a part of a pattern may stand for; with more, the part tells nothing.
MOST = 64
#: Bits of a word of the bit set.
BITS = 62
#: Texts that Python holds at once.
AT_ONCE = 256
#: Stands for any decimal digit of Unicode.
DIGIT = ""
_FOLDED = (("ſ", "s"), ("ı", "i"), ("İ", "i"), ("\u212a", "k"), ("\u212b", "å"))


def fold(text: str) -> str:
    for c, to in _FOLDED:
        if c in text:
            text = text.replace(c, to)
    return text.lower().replace("ς", "σ")


@dataclass(frozen=True, order=True)
class Need:
    """A string that a match holds; ``whole``: as a word, with no part of a word on either side."""

    text: str
    whole: bool = False

    @property
    def weak(self) -> bool:
        """In nearly every text: one letter or space, or nothing."""
        s = self.text
        return not s or len(s) < 2 and not self.whole and (s.isalpha() and s.isascii() or s in " \t\r\n")

    @property
    def common(self) -> bool:
        return len(self.text) < 3 and self.text.isalpha() and self.text.isascii()


#: Runs of what every pattern takes for parts of a word; a string is a whole word if it is such a run.
_WORD = re.compile(r"[a-z0-9_\u00e0-\u00f6\u00f8-\u00ff]+")


def _best(groups: list[frozenset[Need]]) -> frozenset[Need] | None:
    """The group that the fewest texts meet: its shortest string is the longest, then the smallest."""
    return min(groups, key=lambda g: (-min(len(n.text) for n in g), len(g)), default=None)


def _characters(items) -> set[str] | None:
    """The characters of a class, DIGIT for its digits; null if they are not few."""
    out = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(fold(chr(arg)))
        elif op is K.RANGE and arg[1] - arg[0] < 24:
            out |= {fold(chr(c)) for c in range(arg[0], arg[1] + 1)}
        elif op is K.CATEGORY and arg is K.CATEGORY_DIGIT:
            out.add(DIGIT)
        else:
            return None
    return out


def _is(node, at) -> bool:
    return node[0] is K.AT and node[1] is at


def _space(node) -> bool:
    """White space, one or more."""
    return node[0] in (K.MAX_REPEAT, K.MIN_REPEAT) and node[1][0] > 0 and list(node[1][2]) == [(K.IN, [(K.CATEGORY, K.CATEGORY_SPACE)])]


class _Reader:
    """Walks a sequence of nodes. ``run`` holds the strings that end where the walk is; ``left`` tells
    that a word begins where they begin, ``right`` that one ends here."""

    def __init__(self):
        self.groups: list[frozenset[Need]] = []
        self.run: set[str] = {""}
        self.left = self.right = False

    def cut(self, border: bool = False) -> None:
        """Ends the run; with ``border`` no part of a word stands here."""
        if self.run != {""}:
            whole = self.left and (self.right or border)
            found = frozenset(Need(s, whole and bool(_WORD.fullmatch(s))) for s in self.run)
            if not any(n.weak for n in found):
                self.groups.append(found)
        self.run, self.left, self.right = {""}, border, False

    def append(self, more: set[str]) -> None:
        if len(self.run) * len(more) > MOST:
            self.cut()
        if len(more) > MOST:
            self.left = False
            return
        if more == {""}:
            return
        self.run, self.right = {a + b for a in self.run for b in more}, False

    def walk(self, nodes) -> None:
        for op, arg in nodes:
            if op is K.LITERAL:
                self.append({fold(chr(arg))})
            elif op is K.IN:
                found = _characters(arg)
                if found is None:
                    self.cut()
                elif DIGIT in found:  # other digits than ASCII's have no place inside a string
                    self.cut()
                    self.run = found
                    self.cut()
                else:
                    self.append(found)
            elif op is K.AT:
                if arg is K.AT_BOUNDARY:
                    if self.run == {""}:
                        self.left = True
                    else:
                        self.right = True
            elif op is K.SUBPATTERN:
                self.inner([arg[3]])
            elif op is K.BRANCH:
                self.inner(arg[1])
            elif _space((op, arg)):
                self.cut(border=True)
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                low, high, body = arg
                if low == 0:
                    words = _strings(body)
                    if high == 1 and words is not None:
                        self.append(words | {""})
                    else:
                        self.cut()
                elif (words := _strings(body)) is not None and low * max(map(len, words)) <= 4:
                    for _ in range(low):
                        self.append(words)
                    if high != low:
                        self.cut()
                else:
                    self.cut()
                    self.inner([body])
                    self.cut()
            elif op not in (K.ASSERT, K.ASSERT_NOT):
                self.cut()

    def inner(self, branches) -> None:
        words = [_strings(b) for b in branches]
        if None not in words and len(set().union(*words)) <= MOST:
            ends = [all(len(b) and _is(b[i], K.AT_BOUNDARY) for b in branches) for i in (0, -1)]
            self.left = self.left or ends[0] and self.run == {""}
            self.append(set().union(*words))
            self.right = ends[1]
            return
        left = self.left and self.run == {""}
        self.cut()
        each = [_groups(b, left) for b in branches]
        if len(each) == 1:
            self.groups += each[0]
        elif all(each):
            self.groups.append(frozenset().union(*map(_best, each)))


def _strings(nodes) -> set[str] | None:
    """All strings that the nodes stand for, null if they are not few or not known."""
    r = _Reader()
    r.walk(nodes)
    return None if r.groups or r.run == {""} or _open(nodes) else r.run


def _open(nodes) -> bool:
    """Does some node stand for more than the strings that the reader keeps?"""
    for op, arg in nodes:
        if op is K.SUBPATTERN and _open(arg[3]) or op is K.BRANCH and any(map(_open, arg[1])):
            return True
        if op is K.IN and ((c := _characters(arg)) is None or DIGIT in c):
            return True
        if op in (K.MAX_REPEAT, K.MIN_REPEAT) and (arg[0] or arg[1] != 1 or _open(arg[2])):
            return True
        if op not in (K.LITERAL, K.IN, K.SUBPATTERN, K.BRANCH, K.MAX_REPEAT, K.MIN_REPEAT, K.AT, K.ASSERT, K.ASSERT_NOT):
            return True
    return False


def _groups(nodes, left: bool = False) -> list[frozenset[Need]]:
    r = _Reader()
    r.left = left
    r.walk(nodes)
    r.cut()
    return r.groups


def needs(pattern: str) -> list[frozenset[Need]]:
    """Groups of strings; a text without any string of some group has no match. None if nothing is known."""
    groups = {frozenset(n for n in g if not any(m.text in n.text and not m.whole for m in g - {n})) for g in _groups(_parser.parse(pattern))}
    strong = {g for g in groups if not any(n.common for n in g)}
    return sorted(strong or groups, key=sorted)


class Literals:
    """The automaton of a list of patterns."""

    def __init__(self, patterns: Iterable[str]):
        self.needs = {p: needs(p) for p in dict.fromkeys(patterns)}
        self.at = {s: i for i, s in enumerate(sorted({n for gs in self.needs.values() for g in gs for n in g}))}
        self.words = max(1, -(-len(self.at) // BITS))
        self._bits = None
        self.type = "struct<" + ",".join(f"w{i}:bigint" for i in range(self.words)) + ">"

    def finder(self):
        """A function of a text, giving the numbers of its strings."""
        import ahocorasick

        words = {n.text: i for n, i in self.at.items() if n.whole}
        marks = {n.text: i for n, i in self.at.items() if not n.whole and len(n.text) == 1 and n.text != DIGIT}
        digit, found = self.at.get(Need(DIGIT)), ahocorasick.Automaton()
        for n, i in self.at.items():
            if not n.whole and len(n.text) > 1:
                found.add_word(n.text, i)
        found.make_automaton()

        def find(text: str) -> set[int]:
            text = fold(text)
            seen = {i for _, i in found.iter(text)} if len(found) else set()
            seen.update(words[w] for w in words.keys() & set(_WORD.findall(text)))
            characters = set(text)
            seen.update(marks[c] for c in marks.keys() & characters)
            if digit is not None and any(map(str.isdecimal, characters)):
                seen.add(digit)
            return seen

        return find

    def bits(self, text: Column) -> Column:
        """The bit set of each text; all bits for a null."""
        if self._bits is None:  # one function, so that Spark sees that two uses of it are the same
            every, n = set(range(len(self.at))), self.words

            def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                find = self.finder()
                for texts in batches:
                    rows = np.zeros((len(texts), n), np.int64)
                    for lo in range(0, len(texts), AT_ONCE):  # Python holds the strings of a slice alone
                        for row, t in zip(rows[lo:], texts.slice(lo, AT_ONCE).to_pylist()):
                            for i in find(t) if t is not None else every:
                                row[i // BITS] |= 1 << i % BITS
                    yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], [f"w{i}" for i in range(n)])

            self._bits = F.arrow_udf(run, self.type)
        return self._bits(text)

    def every(self) -> Column:
        """A bit set that every pattern is tried on."""
        return F.struct(*(F.lit((1 << BITS) - 1).alias(f"w{i}") for i in range(self.words)))

    def may(self, seen: Column, pattern: str) -> Column | None:
        """Whether ``pattern`` needs to be tried on a text with the bits ``seen``; null if always."""
        tests = []
        for group in self.needs.get(pattern, []):
            masks = {}
            for s in group:
                masks[self.at[s] // BITS] = masks.get(self.at[s] // BITS, 0) | 1 << self.at[s] % BITS
            tests.append(reduce(Column.bitwiseOR, (seen[f"w{w}"].bitwiseAND(F.lit(m)) for w, m in sorted(masks.items()))) != 0)
        return reduce(Column.__and__, tests) if tests else None
