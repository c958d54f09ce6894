"""Operators that compare documents with one another, against brute force."""

import hashlib
import random
import re

import pytest

from tests.llm.conftest import WORDS
from tutorlake.llm import decon, jaccard, lines, suffixes


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def near_copies(seed=3):
    """Families of texts with words changed, one large family, and unrelated texts."""
    rng = random.Random(seed)
    rows, key = [], 0
    for size in (1, 2, 2, 3, 5, 9, 40, 1, 1, 1):
        base = prose(rng, rng.choice([4, 6, 30, 90, 240])).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = "CHANGED" + str(rng.randint(0, 5))
            rows.append((key, " ".join(w) if rng.random() < 0.8 else "  ".join(w).upper()))
            key += 1
    rng.shuffle(rows)
    return rows


def shingle_set(text):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    """Smallest key reachable, by row index."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    keys = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            keys[find(i)] = min(keys.get(find(i), k), k)
    return [(len(s), keys.get(find(i), k)) for i, (s, (k, _)) in enumerate(zip(sets, rows))]


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_classes(docs, odd_rows, seed, monkeypatch):
    if seed == 4:
        monkeypatch.setattr(jaccard, "BLOCK", 3)  # several tiles in a group
    rows = [(k + 100, t) for k, t in near_copies(seed)] + odd_rows
    got = jaccard.components(docs(rows)).collect()
    want = sorted(((k, *c) for (k, _), c in zip(rows, brute_classes(rows))), key=str)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_jaccard_keeps_one_of_each_class(docs):
    rows = near_copies()
    kept = jaccard.keep_first(docs(rows))
    want = {k for (k, _), (_, c) in zip(rows, brute_classes(rows)) if c == k}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs(rows).columns


def test_jaccard_empty(docs):
    assert jaccard.components(docs([])).count() == 0


def brute_lines(rows):
    """(key, line number) to remove, by comparing every two lines."""
    places = sorted((k, i, line) for k, t in rows if k is not None for i, line in enumerate((t or "").split("\n")) if line.strip(" "))
    first = {}
    for k, i, line in places:
        first.setdefault(line, (k, i))
    gone = {(k, i) for k, i, line in places if first[line] != (k, i)}

    def one_edit(a, b):
        x, y = a.split(" "), b.split(" ")
        if min(len(x), len(y)) < 5 or abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(s != t for s, t in zip(x, y)) == 1
        long, short = (x, y) if len(x) > len(y) else (y, x)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    kept = list(first.items())
    for line, place in kept:
        if any(other < place and one_edit(line, o) for o, other in kept if o != line):
            gone.add(place)
    return gone


def edited_lines(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS[:6]) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    rows = []
    for k in range(40):
        out = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(base).split(" ")
            edit = rng.randint(0, 3)
            at = rng.randrange(len(w))
            if edit == 1:
                w[at] = rng.choice(WORDS[:6])
            elif edit == 2:
                w.insert(at, rng.choice(["", *WORDS[:3]]))
            elif edit == 3:
                del w[at]
            out.append(" ".join(w))
        rows.append((k, "\n".join(out)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(docs, odd_rows, seed):
    rows = edited_lines(seed) + [(k and k + 1000, t) for k, t in odd_rows if k != 2]
    got = {(r["doc_id"], r["line_no"]) for r in lines.removed(docs(rows)).collect()}
    assert got == brute_lines(rows)


def spaced_lines(seed):
    """Lines that begin or end with spaces, and edits next to those."""
    rng = random.Random(seed)
    rows = [(0, " b1 b2 b3 b4 b5\nc1 c2 c3 c4 c5 "), (1, " X b1 b2 b3 b4 b5\nc1 c2 c3 c4 c5 X ")]
    for k in range(2, 60):
        w = [f"w{k % 5}{j}" for j in range(rng.randint(5, 7))]
        for _ in range(rng.randint(0, 2)):
            w.insert(rng.choice([0, 1, len(w) - 1, len(w)]), rng.choice(["", "", "x", "y"]))
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_of_spaces(docs, seed):
    rows = spaced_lines(seed)
    got = {(r["doc_id"], r["line_no"]) for r in lines.removed(docs(rows)).collect()}
    assert got == brute_lines(rows) and {(1, 0), (1, 1)} <= got


def test_line_dedup_rebuilds_texts(docs):
    rows = [(1, "a b c d e\nx"), (2, "x\n\na b c d f\nnew"), (3, None), (None, "x"), (4, "x")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs(rows)).collect()}
    assert got == {1: "a b c d e\nx", 2: "\nnew", 3: None, None: "x", 4: ""}
    assert lines.dedup(docs([])).count() == 0
    plan = lines.dedup(docs(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_suffixes(rows, width=50):
    seen, out = {}, {}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for k, t in ordered:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen.get(b[i : i + width], k if k is not None else 1 << 70) < (k if k is not None else 1 << 70):
                cover[i : i + width] = b"\1" * width
        out.setdefault((k, len(b)), []).append(hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
        for i in range(len(b) - width + 1):
            seen.setdefault(b[i : i + width], k if k is not None else 1 << 70)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup(docs, odd_rows, seed, monkeypatch):
    """With seed 1 fingerprints of four bits, so that nearly all collide, and signs split in parts."""
    if seed:
        monkeypatch.setattr(suffixes, "SIGN_RUNS", 2)
    rng = random.Random(seed)
    shared = [prose(rng, 12) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randint(0, 12)), rng.choice(shared)[rng.randint(0, 30) :], "ab" * rng.randint(0, 60), prose(rng, 2)]
        rng.shuffle(parts)
        rows.append((k + 100, "é ".join(parts)))
    rows += [(300, rows[0][1]), (301, rows[0][1]), *odd_rows]
    got = {}
    for r in suffixes.dedup(docs(rows), bits=4 if seed else 64).collect():
        got.setdefault((r["doc_id"], r["n_bytes"]), []).append(r["kept_sha256"])
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    want = brute_suffixes(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert suffixes.dedup(docs([])).count() == 0


def test_family_levels():
    family = suffixes.Family()
    rng = random.Random(1)
    want = {}
    import numpy as np

    for _ in range(30):
        prints = np.array([rng.randrange(400) for _ in range(rng.randint(0, 50))], np.uint64)
        keys = np.array([rng.randrange(1000) for _ in prints], np.int64)
        family.add(prints, keys)
        for p, k in zip(prints.tolist(), keys.tolist()):
            want[p] = min(want.get(p, k), k)
    assert len(family.levels) <= 8
    got = family.first(np.arange(400, dtype=np.uint64))
    assert got.tolist() == [want.get(i, suffixes.LAST) for i in range(400)]


def brute_align(item, words):
    best, rows = 0.0, [[0.0] * (len(words) + 1)]
    for a in item:
        row = [0.0]
        for j, b in enumerate(words):
            row.append(max(0.0, rows[-1][j] + (1.0 if a == b else -decon.PENALTY), rows[-1][j + 1] - decon.PENALTY, row[j] - decon.PENALTY))
        rows.append(row)
        best = max(best, *row)
    return best / len(item) if len(item) else 0.0


def test_alignment():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        item, words = ([rng.randrange(5) for _ in range(rng.randint(1, n))] for n in (8, 14))
        assert decon.align(np.array(item, np.uint64), np.array(words, np.uint64)) == pytest.approx(brute_align(item, words))


def test_leaks(docs, odd_rows, spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(12)]
    rows = [(100 + i, prose(rng, 80)) for i in range(60)]
    planted = set()
    for i, (item, text) in enumerate(items):
        w = text.split()
        for j in range(0, len(w), 7):
            if i % 2:
                w[j] = "edited"
        rows.append((500 + i, prose(rng, 20) + " " + " ".join(w) + " " + prose(rng, 20)))
        planted.add((500 + i, item))
    bench = spark.createDataFrame([*items, (98, None), (99, ""), (97, "one two three")], "item_id long, text string")
    df = docs(rows + odd_rows)
    found = decon.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    kept = decon.clean(df, bench)
    assert kept.count() == len(rows) + len(odd_rows) - len(planted) and kept.columns == df.columns
    assert decon.leaks(docs([]), bench).count() == 0 and decon.leaks(df, bench.limit(0)).count() == 0


def test_leaks_in_many_documents(docs, spark):
    """Copies that make all n-grams they keep frequent: with every fifth word edited, of half an
    item, of nothing but stock phrases; and items of one and two words."""
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(15, 30))) for i in range(6)]
    stock = " ".join(items[2][1].split()[:4])
    rows = [(i, prose(rng, 30)) for i in range(30)] + [(100 + i, prose(rng, 20) + " " + stock) for i in range(50)]
    for i in range(50):
        edited, half = items[0][1].split(), items[1][1].split()
        edited[::5] = [f"edited{i}x{j}" for j in range(len(edited[::5]))]
        rows.append((200 + i, prose(rng, 15) + " " + " ".join(edited) + " " + prose(rng, 15)))
        rows.append((300 + i, prose(rng, 15) + " " + " ".join(half[: (len(half) + 1) // 2]) + " " + prose(rng, 15)))
    rows.append((400, " ".join([stock] * 200) + " " + items[3][1] + " oneword " + "two words " * 3))
    items += [(50, "Oneword"), (51, "two words"), (52, "words two three")]
    want = {}
    for k, text in rows:
        w = text.lower().split()
        for item, t in items:
            asked = t.lower().split()
            if len(asked) > 2 and (score := brute_align(asked, w)) >= decon.LEAST and any(asked[j : j + 3] == w[p : p + 3] for j in range(len(asked) - 2) for p in range(len(w))):
                want[k, item] = pytest.approx(score)
    want |= {(400, 50): 1.0, (400, 51): 1.0}
    assert {(k, i) for k, i in want} >= {(200 + i, 0) for i in range(50)} | {(300 + i, 1) for i in range(50)}
    found = decon.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(want) and {(r["doc_id"], r["item_id"]): r["score"] for r in found} == want


def test_leaks_whatever_was_edited(docs, spark):
    """Every document against every item by brute force, with no condition on seeds: words replaced,
    left out and put in, every third one or at random, of one item or of all items' stock words."""
    rng = random.Random(17)
    common = "of the in to and a is that".split()
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.4 else prose(rng, 1) for _ in range(rng.randint(12, 40)))) for i in range(8)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else prose(rng, 1) for _ in range(60))) for i in range(40)]
    for i in range(160):
        words = items[i % 8][1].split()
        if i < 8:
            words[2::3] = [f"x{i}" for _ in words[2::3]]
        elif i < 16:
            words = [w for x in words for w in (x, f"x{i}")]
        else:
            rate = rng.choice([0.1, 0.2, 0.3, 0.4])
            words = [w for x in words for w in ([x] if rng.random() > rate else rng.choice([["new"], [], [x, "more"]]))]
        rows.append((100 + i, prose(rng, 10) + " " + " ".join(words) + " " + prose(rng, 10)))
    want = {}
    for k, text in rows:
        for item, t in items:
            score = brute_align(t.lower().split(), text.lower().split())
            if score >= decon.LEAST:
                want[k, item] = pytest.approx(score)
    assert {(100 + i, i) for i in range(8)} <= set(want) and len(want) > 100
    bench = spark.createDataFrame([(*x, 1) for x in [*items, items[0]]], "item_id long, text string, score int")
    found = decon.leaks(docs(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found} == want
    assert len(found) == len(want) + sum(item == 0 for _, item in want)
