"""Hashed n-grams of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers, one for each place of an n-gram (fixed values of this module).
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
#: Spaces put before and behind each text, so that no n-gram spans two of them.
PAD = 4


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, PAD spaces before and behind each, and where each begins."""
    pad = " " * PAD
    joined = "".join(f"{pad}{t}{pad}" for t in texts)
    starts = np.cumsum([0, *(len(t) + 2 * PAD for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts.astype(np.int64)


def hashed(code: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each position; buckets is a power of two."""
    h = code * _PRIMES[0] + np.uint32(n * 0x1000193)
    for i in range(1, n):
        nxt = np.zeros_like(code)
        nxt[:-i] = code[i:]
        h = (h ^ (h >> np.uint32(15))) * _PRIMES[i] + nxt * _PRIMES[(i + 2) % 5]
    h ^= h >> np.uint32(13)
    h *= _PRIMES[4]
    return (h >> np.uint32(32 - (buckets - 1).bit_length())).astype(np.int32)


def words(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each run of characters other than white space."""
    space = (code == 32) | ((code >= 9) & (code <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.full(int((end - start).max(initial=0)) + 1, base))
        place = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code)))) if len(start) and start[0] == 0 else None
        if place is None:
            place = np.zeros(len(code), np.int64)
            if len(start):
                place[start[0] :] = np.arange(start[0], len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
        place[space] = 0
        term = np.where(space, np.uint64(0), (code.astype(np.uint64) + np.uint64(1)) * power[place])
        total = np.concatenate([[np.uint64(0)], np.cumsum(term)])
        h = total[end] - total[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return start, h


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values at the positions of each text."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]
