"""Byte-level BPE by a deterministic tokenization automaton.

The automaton reads tokens and accepts, for every byte string, exactly the token sequence
that merging by rank would give. It starts as one state with a loop for each byte. Each merge
``u + v -> uv`` then applies one gadget, in rank order: wherever ``u`` leads to a state that
has an arc ``v``, an arc ``uv`` to the end of ``v`` is added beside ``u``, and ``u`` is led to a
copy of its state without ``v``. Targets depend on the token alone, so a state is the last
token read; a copy differs from its origin by one removed arc. The compiled form is therefore
the list of gadgets with the time of each, from which the slots of a transition table of fixed size
are filled as texts need them (a full table of 50,000 x 50,000 bits would not fit a worker).

Texts are pre-split into words; a word is run through the table from the first state, longest
label first, backing out of positions that no allowed arc leaves. Decoding emits the byte label
of each arc.

Nulls and empty texts encode to no token; a word of any length is one run. Equal rows get equal
results; no row is dropped, an empty table gives none, and other columns are never looked at.
Strings of special tokens inside a text are taken as those tokens, as the vocabulary file says.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlake.llm.common import keyed, map_columns

#: The public pre-splitting pattern of byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of up to 64 characters kept in a worker's cache before it starts anew (about 45 MB).
CACHE_WORDS = 100_000
#: The transition table has 2 ** TABLE_BITS slots of 8 bytes, whatever texts come (8 MB).
TABLE_BITS = 20
_SLOTS, _SPREAD = (1 << TABLE_BITS) - 1, 0x9E3779B97F4B

_WORKER: dict = {}  # one automaton per worker process, kept between tasks


def _byte_of() -> dict[str, int]:
    """The public byte-to-character table of byte-level vocabularies, as a rule: printable
    Latin-1 stands for itself, other bytes for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> dict:
    """Labels (bytes by id), merges (pairs of ids in rank order) and special tokens of a file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte_of = _byte_of()
    vocab = model["model"]["vocab"]
    labels = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]))
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    for token, i in vocab.items():
        labels[i] = token.encode() if token in special else bytes(byte_of[c] for c in token)
    for token, i in special.items():
        labels[i] = token.encode()
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    return {"labels": labels, "merges": merges, "special": special}


class Automaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = labels, special
        self.born = dict.fromkeys((i for i, x in enumerate(labels) if len(x) == 1), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.removed: dict[tuple[int, int], int] = {}
        self.table = array("q", bytes(8 << TABLE_BITS))  # a slot holds the last pair met there and its answer
        for rank, (u, v, uv) in enumerate(merges):
            self._gadget(rank, u, v, uv)
        self.arcs = {labels[t]: t for t in self.born}  # of the first state
        self.prefix: dict[int, int] = {}
        self.walk: dict[int, tuple] = {}  # byte -> (token that ends there or -1, the same one byte on)
        for label, t in self.arcs.items():
            at = self.walk
            for byte in label[:-1]:
                at = at.setdefault(byte, (-1, {}))[1]
            at[label[-1]] = t, at.get(label[-1], (-1, {}))[1]
        self.split = regex.compile(PATTERN).findall
        self.stops = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.decimal = [str(i) for i in range(len(labels))]
        self.words: dict[str, tuple[int, ...]] = {}

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        if u in self.born and v in self.born and self._has_arc(u, v, rank):
            self.removed[u, v] = rank  # u now leads to a copy without the arc v
            if uv not in self.born:
                self.born[uv], self.parts[uv] = rank, (u, v)

    def _has_arc(self, x: int, t: int, now: int) -> bool:
        """Does the state after token ``x`` have an arc ``t`` once the gadgets before ``now`` are in?"""
        while True:
            if self.removed.get((x, t), now) < now:
                return False
            bx, bt = self.born[x], self.born[t]
            if bx < 0 and bt < 0:
                return True
            if bt >= bx:  # the arc came beside the arc of its left part, after that gadget's removal
                t, now = self.parts[t][0], bt + 1
            else:  # the state was that of the right part when its gadget came
                x, now = self.parts[x][1], bx

    def step(self, x: int, t: int) -> bool:
        """The transition table: may ``t`` follow ``x``?"""
        pair = x << 24 | t
        slot = pair * _SPREAD >> 20 & _SLOTS
        held = self.table[slot]
        if held >> 1 != pair:
            held = self.table[slot] = pair << 1 | self._has_arc(x, t, 1 << 60)
        return held & 1

    def _longest(self, data: bytes, at: int) -> int:
        """The longest arc label of the first state that ``data`` has at ``at``."""
        on, found = self.walk, -1
        for byte in data[at:]:
            hit = on.get(byte)
            if hit is None:
                break
            t, on = hit
            if t >= 0:
                found = t
        return found

    def _shorter(self, t: int) -> int:
        """The next shorter arc label that begins the label of ``t``; -1 if there is none."""
        found = self.prefix.get(t)
        if found is None:
            label, arcs = self.labels[t], self.arcs
            found = self.prefix[t] = next((arcs[label[:n]] for n in range(len(label) - 1, 0, -1) if label[:n] in arcs), -1)
        return found

    def word(self, word: str) -> tuple[int, ...]:
        """Run one word through the automaton. Only one path reads all of it; a position from
        which no arc leads on is marked, so that it is entered once."""
        data, labels, step = word.encode("utf-8", "surrogatepass"), self.labels, self.step
        end, at, path, open_at = len(data), 0, [], bytearray(b"\1") * (len(data) + 1)
        t = self._longest(data, 0)
        while at < end:
            to = at + len(labels[t])
            if open_at[to] and (not path or step(path[-1], t)):
                path.append(t)
                at = to
                if at < end:
                    t = self._longest(data, at)
                continue
            t = self._shorter(t)
            while t < 0:
                open_at[at] = 0
                back = path.pop()
                at -= len(labels[back])
                t = self._shorter(back)
        return tuple(path)

    def _plain(self, text: str) -> list[int]:
        """Pre-split by the pattern, then word by word; words met before are kept."""
        parts, words = self.split(text), self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        new = set(parts).difference(words)
        for w in new:
            words[w] = self.word(w)
        ids = list(chain.from_iterable(map(words.__getitem__, parts)))
        for w in new:
            if len(w) > 64:
                del words[w]
        return ids

    def encode(self, text: str) -> list[int]:
        if self.stops is None or not self.stops.search(text):
            return self._plain(text)
        out: list[int] = []
        for part in self.stops.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


def _automaton(shared) -> Automaton:
    if _WORKER.get("of") != (key := shared.value["key"]):
        _WORKER.update(of=key, it=Automaton(shared.value["labels"], shared.value["merges"], shared.value["special"]))
    return _WORKER["it"]


def _share(df: DataFrame, vocabulary: str):
    """The vocabulary goes to the executors as a broadcast; its size is that of the file (about
    2 MB), whatever the corpus. Executors need not have the file."""
    model = load_merges(vocabulary)
    return df.sparkSession.sparkContext.broadcast(model | {"key": hashlib.md5(repr((model["merges"], model["labels"])).encode()).hexdigest()})


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    shared, kind = _share(df, vocabulary), df.schema[key].dataType.simpleString()

    def make():
        auto = _automaton(shared)
        return lambda c: {"doc_id": c["doc_id"], "ids": [auto.encode(x) for x in c["text"]]}

    return map_columns(keyed(df, key, text), f"doc_id {kind}, ids array<int>", "text", make)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of token ids; bytes that are no UTF-8 become U+FFFD."""
    shared, kind = _share(df, vocabulary), df.schema[key].dataType.simpleString()
    df = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"), F.lit("").alias("text"))

    def make():
        auto = _automaton(shared)
        return lambda c: {"doc_id": c["doc_id"], "text": [auto.decode(x).decode("utf-8", "replace") for x in c["ids"]]}

    return map_columns(df, f"doc_id {kind}, text string", "text", make)


def digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, then decode the ids, and keep digests of both, and the ids themselves if they are
    asked for: one pass, no shuffle."""
    shared, kind = _share(df, vocabulary), df.schema[key].dataType.simpleString()

    def make():
        auto = _automaton(shared)

        def run(c):
            n, ids_sha, text_sha, every = [], [], [], []
            for x in c["text"]:
                ids = auto.encode(x)
                n.append(len(ids))
                every.append(ids if with_ids else None)
                ids_sha.append(hashlib.sha256(",".join(map(auto.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(auto.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            return {"doc_id": c["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha, "ids": every}

        return run

    return map_columns(keyed(df, key, text), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, "text", make)
