"""Suffix dedup: bytes of long strings that also start in an earlier document, removed exactly.

A suffix is a position of a text and the ``width`` bytes from it on (50). A byte goes if it is
covered by such a string that also starts in a document with a smaller key; overlaps count, and
strings are judged on the input. Suffixes are indexed by a logarithmic family: each batch of
them becomes a sorted array, arrays of about equal size are merged into one of twice the size
(keeping the smallest key of equal suffixes), and a batch is matched by scanning it against each
of the few arrays. As a match only counts from ``width`` bytes on, suffixes are ordered by the
fingerprint of their first ``width`` bytes, which holds equal ones together as their text would.

The family is cut into shards, so that Spark can deal it out: a suffix belongs to the shard of
its rarest sign, the smallest hash of the ``seed``-byte strings in it (equal suffixes have equal
signs). Suffixes in a row with the same sign form a run and travel as one record.

1. Runs: (sign, digest of the run's bytes). A run that another document of the same slice with a
   smaller key has goes at once. Of the others a shard's index tells whether an earlier document
   has all of it (covered), whether its sign is nowhere else (kept), or whether other runs share
   its sign. Only records are moved, packed per slice of documents and shard; a content that a
   third of all documents hold is one record a slice.
2. Of the last kind, the first run of each content is fetched as bytes and goes, again by sign,
   to an index of its single suffixes, which finds the parts that earlier documents have. Equal
   fingerprints are compared byte by byte there. A sign with very many runs is split: its suffixes
   travel one by one, each to the part that its bytes fall to.
3. Covered spans are gathered per document and taken out of its bytes.

Copies, however many, end in step 1; step 2 sees each content once. Nothing is compared pair by
pair. Equality of whole runs that share a sign is that of 80 bits of a 128-bit digest. Texts count
as UTF-8 bytes, null as empty; texts under ``width`` bytes keep all of them; an empty table gives
no row, other columns are never looked at, and texts of any length are read whole.
Keys are integers; rows with a null key count as after all others and not as earlier ones of each
other, and rows that share a key are no earlier documents of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlake.llm.common import keyed, map_columns, materialize

WIDTH = 50
SEED = 24
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A run's record: sign (48 bits), digest of its bytes (80 bits), start in the document, suffixes in it.
RECORD = np.dtype([("sign", "u1", 6), ("print", "u1", 10), ("start", "<u4"), ("size", "<u4")])
#: A shard holds the runs of about so many bytes of text, or fewer.
SHARD_BYTES = 32_000_000
#: Runs of a sign that one task looks at.
SIGN_RUNS = 1_000
#: Pairs of suffixes compared byte by byte at once.
_PAIRS = 100_000


class _Hashes:
    """Fingerprints of substrings of one buffer, by prefix sums of a polynomial modulo 2**64."""

    powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(self.powers[0]) < n:
            type(self).powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[0][: n - 1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.powers[1][start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Family:
    """Sorted arrays of suffix fingerprints, each with the smallest key that has it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _array(prints: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(prints)), bool), prints[1:] != prints[:-1]]))
        return prints[new], np.minimum.reduceat(keys[order], new) if len(new) else keys

    def add(self, prints: np.ndarray, keys: np.ndarray) -> None:
        level = self._array(prints, keys)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            other = self.levels.pop()
            level = self._array(np.concatenate([other[0], level[0]]), np.concatenate([other[1], level[1]]))
        self.levels.append(level)

    def first(self, prints: np.ndarray) -> np.ndarray:
        """The smallest key that has each suffix; LAST if none does."""
        out = np.full(len(prints), LAST, np.int64)
        for at, keys in self.levels:
            if len(at):
                i = np.minimum(np.searchsorted(at, prints), len(at) - 1)
                np.minimum(out, np.where(at[i] == prints, keys[i], LAST), out=out)
        return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])


def _runs(parts: list[bytes], width: int, seed: int):
    """(document, start, suffixes, sign, digest of ten bytes) of each run of the texts."""
    sizes = np.array([len(p) for p in parts], np.int64)
    joined = b"".join(parts)
    data = np.frombuffer(joined, np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64), np.zeros((0, 10), np.uint8)
    hashes = _Hashes(data)
    at = np.arange(len(data) - seed + 1)
    sign = _least(hashes.of(at, at + seed), width - seed + 1)
    stops = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(parts)), sizes)[: len(sign)]
    ok = np.arange(len(sign)) + width <= stops[doc]
    edge = np.flatnonzero((sign[1:] != sign[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1])) + 1
    start = np.concatenate([[0], edge])
    size = np.diff(np.append(start, len(sign)))
    keep = ok[start]
    start, size = start[keep], size[keep]
    doc = doc[start]
    digest = xxhash.xxh3_128_digest
    prints = b"".join([digest(joined[a:b]) for a, b in zip(start.tolist(), (start + size - 1 + width).tolist())])
    return doc, start - (stops - sizes)[doc], size, sign[start], np.frombuffer(prints, np.uint8).reshape(-1, 16)[:, :10]


def _six(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]


def _eight(b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((len(b), 2), np.uint8), b], 1).view("<u8").ravel()


def _contents(sign: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run, equal for equal sign and digest, and the first run of each number."""
    last = np.zeros((len(sign), 8), np.uint8)
    last[:, :2] = prints[:, 8:]
    high = (sign & ~np.uint64(0xFFFF)) | last.view("<u8").ravel()
    low = np.ascontiguousarray(prints[:, :8]).view("<u8").ravel()
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    ids = np.empty(len(order), np.uint64)
    ids[order] = (np.cumsum(new) - 1).astype(np.uint64)
    return ids, order[new]


def _records(docs: DataFrame, shards: int, width: int, seed: int) -> DataFrame:
    """(shard, keys, tags, counts, records): the runs of a slice of documents that fall into a
    shard, in order of documents; counts tells how many of each document there are. Runs that
    another document of the slice covers have a shard below zero."""

    def run(c):
        out = {k: [] for k in ("shard", "keys", "tags", "counts", "records")}
        doc, start, size, sign, prints = _runs([t.encode("utf-8", "surrogatepass") for t in c["text"]], width, seed)
        rows = np.empty(len(doc), RECORD)
        rows["sign"], rows["print"], rows["start"], rows["size"] = _six(sign), prints, start, size
        keys, tags = np.array([LAST if k is None else k for k in c["doc_id"]], np.int64), np.array(c["tag"], np.int64)
        shard = ((sign >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
        if len(doc):
            ids, first = _contents(_eight(rows["sign"]), prints)
            least = np.full(len(first), LAST, np.int64)
            np.minimum.at(least, ids.astype(np.int64), keys[doc])
            shard[keys[doc] > least[ids.astype(np.int64)]] = -1
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(-1, shards + 1))
        spread = -1 - int(tags[0] % shards) if len(tags) else -1
        for s in range(-1, shards):
            own = order[cuts[s + 1] : cuts[s + 2]]
            if len(own):
                which, n = np.unique(doc[own], return_counts=True)
                for name, v in zip(out, (s if s >= 0 else spread, keys[which], tags[which], n.astype(np.int32), rows[own].tobytes())):
                    out[name].append(v)
        return out

    return map_columns(docs, "shard int, keys array<long>, tags array<long>, counts array<int>, records binary", "text", lambda: run)


def _judge_runs(records: DataFrame) -> DataFrame:
    """(doc_id, tag, start, size, sign, parts): runs that an earlier document covers (sign is null)
    and runs whose suffixes have to be looked at one by one, in so many parts."""
    out = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("sign", pa.int64()), ("parts", pa.int32())])

    def judge(shard, rows):
        every = np.concatenate([np.frombuffer(r[3], RECORD) for r in rows])
        key = np.concatenate([np.repeat(r[0], r[2]) for r in rows])
        tag = np.concatenate([np.repeat(r[1], r[2]) for r in rows])
        sign = _eight(every["sign"])
        parts = np.ones(len(every), np.int32)
        covered = keep = np.ones(len(every), bool)
        if shard >= 0:
            ids, one = _contents(sign, every["print"])
            index, at = Family(), 0
            for r in rows:  # a batch is a slice of documents
                n = int(np.sum(r[2]))
                index.add(ids[at : at + n], key[at : at + n])
                at += n
            # a sign has other runs if it has more than one content
            values, times = np.unique(sign[one], return_counts=True)
            times = times[np.searchsorted(values, sign)]
            covered = index.first(ids) < key
            keep = covered | (times > 1)
            parts = (-(-times // SIGN_RUNS)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(key[keep]), pa.array(tag[keep]), pa.array(every["start"][keep].astype(np.int64)), pa.array(every["size"][keep].astype(np.int64)), pa.array(sign[keep].view(np.int64), mask=covered[keep]), pa.array(parts[keep])],
            schema=out,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard and rows:
                    yield judge(shard, rows)
                    rows = []
                shard = s
                rows.append((np.array(row[0], np.int64), np.array(row[1], np.int64), np.array(row[2], np.int64), row[3]))
        if rows:
            yield judge(shard, rows)

    return records.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "doc_id long, tag long, start long, size long, sign long, parts int")


def _told_apart(prints: np.ndarray, data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The fingerprints, changed where different strings share one: equal ones are compared byte by byte."""
    windows = np.lib.stride_tricks.sliding_window_view(data, width)
    order = np.argsort(prints, kind="stable")
    same = np.flatnonzero(prints[order[1:]] == prints[order[:-1]])
    wrong = []
    for i in range(0, len(same), _PAIRS):
        k = same[i : i + _PAIRS]
        differ = (windows[at[order[k]]] != windows[at[order[k + 1]]]).any(1)
        wrong.append(prints[order[k[differ]]])
    wrong = np.unique(np.concatenate(wrong)) if wrong else np.zeros(0, np.uint64)
    if len(wrong):
        prints, names, taken = prints.copy(), {}, set(np.unique(prints).tolist())
        for i in np.flatnonzero(np.isin(prints, wrong)).tolist():
            text = windows[at[i]].tobytes()
            if text not in names:
                new = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
                while new in taken:
                    new = (new + 1) & (1 << 64) - 1
                taken.add(new)
                names[text] = new
            prints[i] = names[text]
    return prints


def _judge_suffixes(runs: DataFrame, width: int, bits: int = 64) -> DataFrame:
    """(doc_id, tag, start, end): parts of runs (given with their bytes) that earlier documents
    have. ``bits`` narrows the fingerprints; it changes no result."""
    out = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, raw, kept, offset = Family(), [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("bytes").to_pylist()
            size = np.array([len(r) - width + 1 for r in own], np.int64)
            base = np.cumsum(np.concatenate([[0], size[:-1] + width - 1]))
            nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(base, size) + nth
            raw.append(b"".join(own))
            prints = _Hashes(np.frombuffer(raw[-1], np.uint8)).of(at, at + width) >> np.uint64(64 - bits)
            row = np.repeat(np.arange(len(size)), size)
            kept.append((prints, row, nth, at + offset, *(batch.column(k).to_numpy().astype(np.int64) for k in ("doc_id", "tag", "start"))))
            offset += len(raw[-1])
        if not kept:
            return
        data = np.frombuffer(b"".join(raw), np.uint8)
        prints = _told_apart(np.concatenate([k[0] for k in kept]), data, np.concatenate([k[3] for k in kept]), width)
        cuts = np.cumsum([0, *(len(k[0]) for k in kept)])
        pieces = [prints[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for own, k in zip(pieces, kept):
            index.add(own, k[4][k[1]])
        for own, (_, row, nth, _, key, tag, start) in zip(pieces, kept):
            hit = np.flatnonzero(index.first(own) < key[row])
            row, nth = row[hit], nth[hit]
            edge = np.ones(len(hit), bool)
            edge[1:] = (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)
            s, e = np.flatnonzero(edge), np.flatnonzero(np.append(edge[1:], True)[: len(hit)])
            r = row[s]
            yield pa.RecordBatch.from_arrays([pa.array(key[r]), pa.array(tag[r]), pa.array(start[r] + nth[s]), pa.array(start[r] + nth[e] + width)], schema=out)

    return runs.repartition("sign", "part").mapInArrow(run, "doc_id long, tag long, start long, end long")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, bits: int = 64) -> DataFrame:
    """(doc_id, tag, start, end): byte spans, they may overlap, that also start in an earlier
    document. ``tag`` is the hash of the row's text: with the key it names the row."""
    spark = df.sparkSession
    docs = _tagged(df, key, text)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    judged = materialize(_judge_runs(_records(docs, shards, width, seed)))
    covered = judged.where("sign is null").select("doc_id", "tag", "start", (F.col("start") + F.col("size") + F.lit(width - 1)).alias("end"))
    asked = judged.where("sign is not null").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "size", "sign", "parts")).alias("asked"))
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "tag", "text").dropDuplicates(["doc_id", "tag"]).join(asked, ["doc_id", "tag"])
    fetched = texts.select("doc_id", "tag", F.col("text").cast("binary").alias("raw"), F.explode("asked").alias("a"))
    run = F.substring("raw", F.col("a.start").cast("int") + 1, F.col("a.size").cast("int") + F.lit(width - 1))
    fetched = fetched.select("doc_id", "tag", "a.*", run.alias("run"))
    one = lambda i: F.struct((F.col("start") + i).alias("start"), F.substring("run", i + 1, F.lit(width)).alias("bytes"))
    alone = F.transform(F.sequence(F.lit(0), F.col("size").cast("int") - 1), one)
    pieces = F.when(F.col("parts") > 1, alone).otherwise(F.array(F.struct("start", F.col("run").alias("bytes"))))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("bytes"), F.col("parts"))).otherwise(0)
    fetched = fetched.select("doc_id", "tag", "sign", "parts", F.inline(pieces)).withColumn("part", part).drop("parts")
    parts = materialize(_judge_suffixes(fetched, width, bits))
    return covered.unionByName(parts)


def _tagged(df: DataFrame, key: str, text: str) -> DataFrame:
    docs = keyed(df, key, text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")


def _union(spans) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not spans:
        return []
    s = np.array([(x["start"], x["end"]) for x in spans], np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.flatnonzero(np.concatenate([[True], s[1:, 0] > reach[:-1]]))
    return list(zip(s[new, 0].tolist(), np.append(reach[new[1:] - 1], reach[-1]).tolist()))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary, kept_sha256) of every row."""
    found = repeats(df, key, text, width, seed, bits).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    docs = _tagged(df, key, text)
    rows = docs.withColumn("__key", F.coalesce("doc_id", F.lit(LAST))).join(found.withColumnRenamed("doc_id", "__key"), ["__key", "tag"], "left").select("doc_id", "text", "spans")

    def run(c):
        out = {k: [] for k in ("doc_id", "n_bytes", "spans", "kept", "kept_sha256")}
        for k, t, s in zip(c["doc_id"], c["text"], c["spans"]):
            raw, merged = t.encode("utf-8", "surrogatepass"), _union(s)
            cuts = [0, *(x for span in merged for x in span), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            for name, v in zip(out, (k, len(raw), [{"start": a, "end": b} for a, b in merged], kept, hashlib.sha256(kept).hexdigest())):
                out[name].append(v)
        return out

    return map_columns(rows, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string", "text", lambda: run)
