"""The prefix trie of conversations against a brute-force version."""

import hashlib
import random
import re
import zlib

import pytest

from tutorlake.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, path string, shard int, skeleton bigint, above int, turns int, words string"


@pytest.fixture
def talks(spark):
    """Make a conversations table, with columns of clashing names, from (conv_id, turn, role, text) rows."""
    return lambda rows: spark.createDataFrame([(*r, "d", "p", 1, 2, 3, 4, "w") for r in rows], SCHEMA).repartition(3)


def brute(rows, family=None, most=4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (r, t)))
    paths = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    if family:
        whole = {}
        for c, turns in paths.items():
            h = zlib.crc32(str(c).encode()) % most
            whole[c] = paths.get(c - (c % family if c >= 0 else -(-c % family)), [])[:h] + turns[h:]
        paths = whole
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for p, of in members.items():
        kids = [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        under = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ends = sorted(c for c in of if len(paths[c]) == len(p))
        out.append((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = [x.split()[0] for x in trie.NODE.split(", ")]
    assert df.columns == names
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def some(seed, n=70):
    """Conversations over few turns, so that many share beginnings; some are equal, some long."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), n):
        first = rng.choice(["hello there", "hello  there", "a b c", ""])
        turns = [("user", first)] + [(rng.choice(["user", "bot"]), rng.choice(["yes", "no no", "x y z"])) for _ in range(rng.choice([0, 1, 2, 3, 5]))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


ODD = [
    (5, None, "user", "first"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, "user", ""), (5, 1, "", "user"), (None, 0, "user", "no key"), (None, None, None, None), (-25, 0, "user", "hello there"),
    (300, 0, "user", "w " * 50_000), (300, 1, "bot", "é漢字 😀\x0b\x85 x"), (301, 0, "user", "w " * 50_000), (302, -3, "user", "early"), (302, 7, "user", "late"),
]


@pytest.mark.parametrize("family", [None, 20])
@pytest.mark.parametrize("shards", [1, 7, 40])
def test_trie(talks, family, shards, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    rows = some(1) + ODD + [(400 + i, 0, "user", "same") for i in range(30)] + [(500, i, "user", f"turn {i}") for i in range(300)] + [(501, i, "user", f"turn {i}") for i in range(280)]
    own = trie.own_turns(talks(rows))
    got = trie.nodes(own if family is None else trie.rebuilt(own, family, 4), shards)
    assert found(got) == brute(rows, family)


def test_a_bound_on_splitters_changes_no_row(talks, monkeypatch):
    monkeypatch.setattr(trie, "LONGEST", 2)
    rows = some(2, 120)
    assert found(trie.nodes(trie.own_turns(talks(rows)), 16)) == brute(rows)


def test_turnless_members_and_empty_tables(talks):
    """Without a first conversation of the family, a conversation of h turns has none left."""
    rows = [(c, 0, "user", "only turn") for c in (41, 42, 43, 44, 45, 46)]
    got = found(trie.prefix_trie(talks(rows), family=20))
    assert got == brute(rows, 20) and [r[3] for r in got if r[1] == 0] == [6]
    assert trie.prefix_trie(talks([]), family=20).count() == 0
    assert trie.prefix_trie(talks([(None, 1, "user", "x")])).count() == 0
