"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy.

A word is a run of bytes other than space and the control characters 9 to 13, A-Z in lower case.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX
        return h ^ (h >> np.uint64(29))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, start and end byte of each word of all texts, the first word of each text (one more
    entry than texts), and the joined lower-case bytes."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(parts).lower() + b"\n"
    data = np.frombuffer(joined, np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    hashes = _runs(data, gap, start, end)
    stops = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return hashes, start, end, np.searchsorted(start, stops), joined


def _runs(data, gap, start, end) -> np.ndarray:
    """Polynomial hash of each run, by prefix sums; long runs are folded over 4096 powers."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        size = end - start
        longest = int(size.max())
        power = np.cumprod(np.full(longest + 1, _BASE, np.uint64))
        place = np.arange(len(data), dtype=np.int64)
        place -= np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(data)]])))
        np.minimum(place, longest, out=place)
        term = (data.astype(np.uint64) + np.uint64(1)) * power[place]
        term[gap] = 0
        total = np.concatenate([[np.uint64(0)], np.cumsum(term)])
        return mix(total[end] - total[start] + size.astype(np.uint64) * _MIX)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each word (over text borders too)."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for i in range(n):
            out = out * _BASE + hashes[i : i + len(out)]
        return mix(out)


def sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer than n words has one, all of it."""
    hashes, _, _, first, _ = words(texts)
    of = runs_of(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(of[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(runs_of(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
