"""Circulant MinHash classes against all pairs."""

import random

import numpy as np
import pytest

from tests.llm.conftest import WORDS
from tests.llm.test_joins import near_copies, prose, shingle_set
from tutorlake.llm import minhash, shingles


def brute(rows, percent=85):
    """(doc_id, n, component, kept) of each row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    out = [(k, len(s), least.get(find(i), k)) for i, (s, (k, _)) in enumerate(zip(sets, rows))]
    return sorted(((k, n, c, k == c) for k, n, c in out), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_classes(docs, odd_rows, seed):
    rows = [(k + 100, t) for k, t in near_copies(seed)] + odd_rows
    assert found(minhash.components(docs(rows))) == brute(rows)


def test_a_bucket_of_many_classes(docs, monkeypatch):
    """Texts alike but not enough share buckets; cells of few sets still find each link, far apart or not."""
    monkeypatch.setattr(minhash, "PART", 4)
    rng = random.Random(5)
    base = prose(rng, 120).split()
    rows = []
    for k in range(60):
        w = list(base)
        for i in range(k % 7 * 3, k % 7 * 3 + 10):
            w[(i * 11 + k % 7) % len(w)] = f"own{k % 20}"
        w[k] = f"one{k}" if k % 3 else w[k]
        rows.append((k, " ".join(w)))
    rng.shuffle(rows)
    for percent in (85, 70):
        want = brute(rows, percent)
        assert len({r[2] for r in want}) > 3
        assert found(minhash.components(docs(rows), percent=percent)) == want


def test_chains(docs):
    """Each text links with the next one only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(500 - k, " ".join(words[k * 8 : k * 8 + 200])) for k in range(20)]
    assert found(minhash.components(docs(rows))) == brute(rows)
    assert {r[2] for r in brute(rows)} == {481}


def test_repeated_rows_and_empty_tables(docs):
    assert minhash.components(docs([])).count() == 0
    rows = [(2, " ".join(WORDS)), (2, " ".join(WORDS)), (1, " ".join(WORDS).upper()), (3, None), (4, "")]
    assert found(minhash.components(docs(rows))) == brute(rows)


def test_signatures_estimate_the_similarity():
    """The share of equal coordinates is the similarity; sets in pieces and in blocks get the same."""
    rng = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.85):
        a, b = [], []
        for _ in range(60):
            both, one, two = np.split(rng.integers(0, 1 << 63, 300, np.uint64), [int(300 * share), int(300 * share) + (300 - int(300 * share)) // 2])
            a.append(np.concatenate([both, one]))
            b.append(np.concatenate([both, two]))
        got = (minhash.signatures(a) == minhash.signatures(b)).mean()
        assert abs(got - share) < 0.02
    long = shingles.sets([" ".join(f"w{i}" for i in range(3 * minhash.BLOCK))])
    pieces = [minhash.signatures([long[0][i : i + 1000]]) for i in range(0, len(long[0]), 1000)]
    assert (minhash.signatures(long) == np.min(pieces, axis=0)).all()
    assert (minhash.signatures([*a, *long, *b])[len(a)] == minhash.signatures(long)[0]).all()


def test_coordinates_are_shifts_of_one_permutation():
    """Coordinate k of a set is coordinate 0 of the set moved back by k places of the first permutation."""
    s = np.arange(10, dtype=np.uint64) << np.uint64(32)
    scattered = minhash._permute(np.arange(10, dtype=np.uint32), minhash._SCATTER)
    got = minhash.signatures([s])[0]
    for k in (0, 1, 50, 95):
        assert got[k] == minhash._permute(scattered - np.uint32(k), minhash._SECOND).min()
    assert len(np.unique(minhash._permute(np.arange(1 << 16, dtype=np.uint32), minhash._SECOND))) == 1 << 16
