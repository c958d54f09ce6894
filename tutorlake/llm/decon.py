"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Documents that share enough seeds with a test item are aligned with it around those places:
Smith-Waterman over words, one point for an equal word, ``PENALTY`` off for another, a missing or an
additional one. The score is the share of the item's words that the best local alignment gains;
``least`` or more is a leak.

The seeds of an item of ``LONG`` words or more are pairs of words next to each other or with one
between them, in the item and in the text. An alignment of s points has s - 1 or more of them: of its
pairs of matches in a row, only those with two errors or more between them are no seed, and two
errors cost a point. So an item of L words needs least * L - 1 places that begin a shared pair, and
no leak is missed, whatever was edited. The places whose pairs are the most frequent among all items
are no seeds, up to half of the places needed; each that is left out lowers the need by one. How often
a seed occurs in the corpus does not matter: a passage that leaked into many documents makes its own
seeds frequent. Shorter items ask for two word 3-grams (one below six words, the whole text below
three), as three common words in a row would make half of such an item. What a document shares by
stock phrases alone is told by counting: stretches of it with too few seeds near each other, or too
few words of the item to reach ``least``, are not aligned.

The benchmark is the stated query set: it is taken in blocks of bounded size, each broadcast to
the tasks that read the documents, of which nothing is shuffled. Items without words match
nothing; null texts count as empty. Repeated rows, of documents or items, give equal rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlake.llm import shingles
from tutorlake.llm.common import keyed, map_columns, small_side, unused

WORDS = 3
PENALTY = 0.5
LEAST = 0.45
#: Words from which on an item's seeds are pairs of words.
LONG = 12
#: Characters of test items in a block.
BLOCK_CHARS = 8_000_000
_TABLE = 1 << 22
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Pairs of a place in a text and a place in an item that are looked at together.
_PAIRS = 1 << 20


def align(item: np.ndarray, words: np.ndarray) -> float:
    """Smith-Waterman score of two rows of word hashes, over the words of the item."""
    if not len(item) or not len(words):
        return 0.0
    slope = PENALTY * np.arange(len(words) + 1)
    row, best = np.zeros(len(words) + 1), 0.0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(words == w, 1.0, -PENALTY), row[1:] - PENALTY)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope
        best = max(best, float(row.max()))
    return best / len(item)


def _width(item: np.ndarray, least: float) -> int:
    """The most words of a text that an alignment of ``least`` or more can span."""
    return int(len(item) * (1 + (1 - least) / PENALTY)) + 1


def _pairs(hashes: np.ndarray, gap: int) -> np.ndarray:
    """Hash of each word and the one ``gap`` places on."""
    with np.errstate(over="ignore"):
        return shingles.mix(hashes[:-gap] * _ODD + hashes[gap:])


def _stretches(item: np.ndarray, words: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The parts of ``words`` that can hold an alignment of ``least`` or more: it has ``least`` of
    the item's words, and too few others for it to be longer than ``width``."""
    width = min(len(words), _width(item, least))
    upto = np.concatenate([[0], np.cumsum(np.isin(words, item))])
    start = np.flatnonzero(upto[width:] - upto[:-width] >= least * len(item) - 1e-9) if width else np.zeros(0, np.int64)
    parts = np.split(start, np.flatnonzero(np.diff(start) > 1) + 1) if len(start) else []
    return [(int(p[0]), int(p[-1]) + width) for p in parts]


class _Seeds:
    """Items of a block by their seeds: of one kind, words in a row (``gaps`` empty) or pairs."""

    def __init__(self, items: list[np.ndarray], least: float, long: bool, n: int = WORDS):
        self.items, self.n, self.long = items, n, long
        mine = [(i, words) for i, words in enumerate(items) if (len(words) >= LONG) == long and len(words)]
        self.sizes = [1, 2] if long else sorted({min(n, len(words)) for _, words in mine})
        self.needed = np.full(len(items), 1, np.int64)
        self.width = np.array([_width(words, least) for words in items], np.int64)
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, words in mine:
            grams = [_pairs(words, gap) for gap in self.sizes] if long else [shingles.runs_of(words, min(n, len(words)))]
            gram, place = np.concatenate(grams), np.concatenate([np.arange(len(g)) for g in grams])
            parts.append((gram, np.full(len(gram), i), place))
            self.needed[i] = max(1, np.ceil(least * len(words) - 1e-9) - 1) if long else 2 if len(words) >= 2 * n else 1
        gram, item, place = map(np.concatenate, zip(*parts))
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        if long:
            self._leave_out_frequent()
        self.maybe = np.zeros(_TABLE, bool)
        self.maybe[(self.gram & np.uint64(_TABLE - 1)).astype(np.int64)] = True

    def _leave_out_frequent(self) -> None:
        """Half of the places that an item needs may go without loss: those of its most frequent pairs."""
        _, at, times = np.unique(self.gram, return_inverse=True, return_counts=True)
        most = {}
        for i, p, k in zip(self.item.tolist(), self.place.tolist(), times[at].tolist()):
            most[i, p] = max(k, most.get((i, p), 0))
        out, left = set(), {i: int(self.needed[i]) // 2 for i in set(self.item.tolist())}
        for (i, p), k in sorted(most.items(), key=lambda x: (-x[1], x[0])):
            if k > 1 and left[i]:
                left[i] -= 1
                self.needed[i] -= 1
                out.add((i, p))
        keep = np.array([x not in out for x in zip(self.item.tolist(), self.place.tolist())], bool)
        self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]

    def hits(self, hashes: np.ndarray, first: np.ndarray):
        """(text, position, gram) of seeds in the texts whose first words are given, by text."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for size in self.sizes if len(self.gram) else ():
            grams = _pairs(hashes, size) if self.long else shingles.runs_of(hashes, size)
            at = np.flatnonzero(self.maybe[(grams & np.uint64(_TABLE - 1)).astype(np.int64)])
            lo = np.searchsorted(self.gram, grams[at])
            at = at[self.gram[np.minimum(lo, len(self.gram) - 1)] == grams[at]]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + size + self.long <= first[doc + 1]
            found.append((doc[inside], at[inside], grams[at[inside]]))
        doc, at, grams = map(np.concatenate, zip(*found))
        order = np.argsort(doc, kind="stable")
        return doc[order], at[order], grams[order]

    def near(self, doc: np.ndarray, at: np.ndarray, grams: np.ndarray):
        """(text, item, positions, places in the item) of the texts with enough seeds of an item."""
        lo = np.searchsorted(self.gram, grams)
        times = np.searchsorted(self.gram, grams, "right") - lo
        upto = np.cumsum(times)
        begin = 0
        while begin < len(doc):
            # whole texts at once, at least one
            end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _PAIRS, "right"))
            end = int(np.searchsorted(doc, doc[end], "left")) if end < len(doc) else end
            end = end if end > begin else int(np.searchsorted(doc, doc[begin], "right"))
            k = times[begin:end]
            seed = np.repeat(lo[begin:end] - np.cumsum(k) + k, k) + np.arange(k.sum())
            pair = np.repeat(doc[begin:end], k) * len(self.items) + self.item[seed]
            rows = self._enough(np.stack([pair, np.repeat(at[begin:end], k), self.place[seed]]))
            edge = np.flatnonzero(np.diff(rows[0], prepend=-1))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), rows.shape[1]]):
                d, i = divmod(int(rows[0, a]), len(self.items))
                yield d, i, rows[1, a:b], rows[2, a:b]
            begin = end

    def _enough(self, rows: np.ndarray) -> np.ndarray:
        """Of (pair of text and item, position, place), those of pairs with enough places, by position."""
        rows = rows[:, np.lexsort((rows[1], rows[2], rows[0]))]
        new = np.diff(rows[0], prepend=-1) != 0
        places = np.cumsum(new | (np.diff(rows[2], prepend=-1) != 0))
        edge = np.append(np.flatnonzero(new), rows.shape[1])
        upto = np.concatenate([[0], places])
        enough = upto[edge[1:]] - upto[edge[:-1]] >= self.needed[rows[0, edge[:-1]] % len(self.items)]
        rows = rows[:, np.repeat(enough, np.diff(edge))]
        return rows[:, np.lexsort((rows[2], rows[1], rows[0]))]

    def groups(self, i: int, at: np.ndarray, own: np.ndarray):
        """(first position, last position, places) of the seeds that lie near enough to each other for
        one alignment, where there are enough of them."""
        need, width = int(self.needed[i]), int(self.width[i])
        start = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= width)
        if not len(start):
            return
        keep = np.zeros(len(at) + 1, np.int64)
        np.add.at(keep, start, 1)
        np.add.at(keep, start + need, -1)
        at, own = at[np.cumsum(keep[:-1]) > 0], own[np.cumsum(keep[:-1]) > 0]
        for g in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > width) + 1):
            n_own = len(np.unique(own[g]))
            if n_own >= need:
                yield int(at[g[0]]), int(at[g[-1]]), n_own


def _block(items: DataFrame) -> tuple[list, list[np.ndarray]]:
    got = items.orderBy("item_id").toPandas()
    texts = got["text"].tolist()
    hashes, _, _, first, _ = shingles.words(texts)
    return got["item_id"].tolist(), [hashes[a:b] for a, b in zip(first[:-1], first[1:])]


def _scores(kinds: list[_Seeds], texts: list[str], least: float):
    """(text, item, score, seeds) of what is a leak."""
    hashes, _, _, first, _ = shingles.words(texts)
    for seeds in kinds:
        for d, i, at, own in seeds.near(*seeds.hits(hashes, first)):
            item, width = seeds.items[i], int(seeds.width[i])
            best = found = 0
            for a, b, n_own in seeds.groups(i, at, own):
                words = hashes[max(first[d], a - width) : min(first[d + 1], b + width + seeds.n)]
                score = max((align(item, words[x:y]) for x, y in _stretches(item, words, least)), default=0.0)
                if score > best:
                    best, found = score, n_own
            if best >= least - 1e-9:
                yield d, i, best, found


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, n_seeds): a row for each document and test item that it holds."""
    rows, items = keyed(docs, key, text), keyed(benchmark, item_key, item_text, "item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_CHARS))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double, n_seeds int"
    found = []
    for b in range(blocks):
        ids, words = _block(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b))
        shared = docs.sparkSession.sparkContext.broadcast((ids, words))

        def make(shared=shared):
            names, known = shared.value
            seeds = [_Seeds(known, least, long) for long in (False, True)]

            def run(c):
                got = list(_scores(seeds, c["text"], least))
                return {"doc_id": [c["doc_id"][d] for d, *_ in got], "item_id": [names[i] for _, i, *_ in got], "score": [s for _, _, s, _ in got], "n_seeds": [n for *_, n in got]}

            return run

        found.append(map_columns(rows, schema, "text", make))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The documents that hold no test item; all columns stay, and so do rows without a key."""
    leak = unused(docs, "leak")
    gone = leaks(docs, benchmark, key=key, **how).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(small_side(gone), F.col(key) == F.col(leak), "left_anti")
