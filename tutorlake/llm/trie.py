"""Conversation prefix trie by splitter-skeleton: what conversations share from their first turn on.

1. Turns become 16-byte digests of (role, text) with their number of words; texts go no further.
   A conversation is the array of its digests in order of turn (null first, ties by digest).
2. A bounded sample of the paths gives the splitters of a range partition: the shortest path that
   tells two neighbours of the sample apart, with the key where the paths are equal, so that a path
   many conversations have is split too. The trie of the splitter paths is the skeleton: only its
   nodes can have members in two shards, as a node whose path is no prefix of a splitter lies on
   one side of it.
3. Each task sorts one shard and walks it with a stack of open nodes. A node off the skeleton is
   finished there. A node of the skeleton leaves partial sums, and the keys that end at it in blocks.
4. The partial sums are added up by Spark, then rolled up along the skeleton (a few nodes for
   each splitter). Blocks of keys are hashed in order as a stream.

A task holds the open nodes of its shard and the finished children of each of them; a conversation
is held as 20 bytes a turn. The driver sees the sample (at most SAMPLE paths a shard, of at most
LONGEST turns each) and the sums of the skeleton. One list of keys is hashed by one task, as
SHA-256 asks for; it holds one block of it.

Null role or text counts as empty, rows without a key belong to no conversation, repeated rows are
turns of their own. An empty table gives no row. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlake.llm.common import materialize

#: Rows of the sample for each shard, and turns of a path that a splitter may have.
SAMPLE = 64
LONGEST = 4096
#: Keys in a block of those that end at a node of the skeleton.
BLOCK = 8192
#: Rows handed to Python at once.
ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_OUT = f"{NODE}, skeleton long, above long, shard long, seq long, ids binary"


# --- paths --------------------------------------------------------------------------------------
def own_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): for each conversation its turns as array<struct<digest, words>>, in order."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("at"), digest.alias("digest"), F.regexp_count(t, F.lit(WORD)).alias("words"))
    listed = F.sort_array(F.collect_list(F.struct("at", "digest", "words")))
    return rows.groupBy("conv_id").agg(F.transform(listed, lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, family: int, most: int) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % ``family``, all if it
    has fewer, h being crc32 of c modulo ``most``; its own turns after the first h follow."""
    c = F.col("conv_id")
    head = own.where(c % family == 0).select(c.alias("first"), F.slice("turns", 1, most).alias("lead"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    kind = own.schema["turns"].dataType.simpleString()
    lead = F.coalesce(F.slice("lead", F.lit(1), h), F.array().cast(kind))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.join(head, c - c % family == F.col("first"), "left").select("conv_id", F.concat(lead, rest).alias("turns"))


# --- splitters ----------------------------------------------------------------------------------
def _shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def splitters(paths: DataFrame, shards: int) -> list[tuple[list[bytes], int]]:
    """At most shards - 1 keys (path, conv_id), in order; rows from a key up to the next are a shard."""
    got = paths.select("conv_id", F.slice("path", 1, LONGEST).alias("path")).orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE * shards).collect()
    rows = sorted(([bytes(x) for x in r["path"]], r["conv_id"]) for r in got)
    out = []
    for i in range(1, shards):
        at = i * len(rows) // shards
        if 0 < at < len(rows):
            (before, _), (path, conv) = rows[at - 1], rows[at]
            found = (path, conv) if path == before else (path[: _shared(before, path) + 1], -(1 << 63))
            if not out or out[-1] < found:
                out.append(found)
    return out


class Skeleton:
    """The trie of the splitter paths; node 0 is the root, parents come before their children."""

    def __init__(self, paths: list[list[bytes]]):
        self.parent, self.depth, self.below = [-1], [0], [{}]
        for path in paths:
            at = 0
            for turn in path:
                if turn not in self.below[at]:
                    self.below[at][turn] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                    self.below.append({})
                at = self.below[at][turn]


# --- a shard ------------------------------------------------------------------------------------
class _Node:
    __slots__ = ("turn", "words", "skeleton", "n", "low", "kids", "leaves", "saved", "ends", "rows")

    def __init__(self, turn: bytes, words: int, skeleton: int | None):
        self.turn, self.words, self.skeleton = turn, words, skeleton
        self.n = self.kids = self.leaves = self.saved = 0
        self.low = self.ends = None
        self.rows = []


class _Walk:
    """Walks paths in order and gathers rows of _OUT."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard, self.seq, self.out = skeleton, shard, 0, []
        self.stack = [_Node(b"", 0, 0)]

    def add(self, conv: int, path: list[bytes], words: list[int]) -> None:
        stack, depth = self.stack, 0
        most = min(len(stack) - 1, len(path))
        while depth < most and stack[depth + 1].turn == path[depth]:
            depth += 1
        while len(stack) > depth + 1:
            self.close()
        for turn, n in zip(path[depth:], words[depth:]):
            above = stack[-1].skeleton
            stack.append(_Node(turn, n, None if above is None else self.skeleton.below[above].get(turn)))
        node = stack[-1]
        node.n += 1
        node.low = conv if node.low is None or conv < node.low else node.low
        if node.skeleton is None:
            if node.ends is None:
                node.ends = hashlib.sha256(b"%d" % conv)
            else:
                node.ends.update(b",%d" % conv)
        else:
            if node.ends is None:
                node.ends = []
            node.ends.append(conv)
            if len(node.ends) >= BLOCK:
                self.block(node)

    def block(self, node: _Node) -> None:
        if node.ends:
            self.out.append((*[None] * 8, node.skeleton, None, self.shard, self.seq, ",".join(map(str, node.ends)).encode()))
            self.seq += 1
            node.ends = []

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        if node.skeleton is not None:  # what its own skeleton children have is added later
            self.block(node)
            self.out.append((node.low, depth, None, node.n, node.kids, node.leaves, node.saved, None, node.skeleton, None, self.shard, node.words, None))
            return
        if not node.kids:
            node.leaves = 1
        node.saved += (node.n - 1) * node.words
        for row in node.rows:
            self.out.append((*row[:2], node.low, *row[3:], *[None] * 5))
        own = (node.low, depth, None, node.n, node.kids, node.leaves, node.saved, node.ends.hexdigest() if node.ends else EMPTY)
        above = self.stack[-1]
        above.n += node.n
        above.low = node.low if above.low is None or node.low < above.low else above.low
        above.kids += 1
        above.leaves += node.leaves
        above.saved += node.saved
        if above.skeleton is None:
            above.rows.append(own)
        else:
            self.out.append((*own, None, above.skeleton, None, None, None))

    def end(self) -> None:
        while self.stack:
            self.close()


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _in_shards(paths: DataFrame, points: list, shards: int) -> DataFrame:
    """``paths`` with their shard, each shard in a partition of its own, in order."""
    shared = paths.sparkSession.sparkContext.broadcast(points)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                part = whole.slice(lo, ROWS)
                at = [bisect_right(shared.value, (p, c)) for p, c in zip(part.column("path").to_pylist(), part.column("conv_id").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.int32())], names=[*part.schema.names, "shard"])

    named = paths.mapInArrow(assign, "conv_id long, path array<binary>, words array<int>, shard int")
    return named.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")


def nodes(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, turns as by ``own_turns``), one row each, as NODE."""
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = materialize(paths.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.words").alias("words")))
    points = splitters(paths, shards)
    skeleton = Skeleton([p for p, _ in points])
    shared, out = spark.sparkContext.broadcast(skeleton), _arrow(_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                part = whole.slice(lo, ROWS).to_pydict()
                for conv, path, words, shard in zip(part["conv_id"], part["path"], part["words"], part["shard"]):
                    if walk is None or walk.shard != shard:
                        done = []
                        if walk:
                            walk.end()
                            done = walk.out
                        walk = _Walk(shared.value, shard)
                        walk.out = done
                    walk.add(conv, path, words)
                while walk.out:
                    rows, walk.out = walk.out[:10_000], walk.out[10_000:]
                    yield _batch(rows, out)
        if walk:
            walk.end()
            for lo in range(0, len(walk.out), 10_000):
                yield _batch(walk.out[lo : lo + 10_000], out)

    found = materialize(_in_shards(paths, points, shards).mapInArrow(run, _OUT))
    names = [x.split()[0] for x in NODE.split(", ")]
    top = _summed(found, skeleton)
    ends = _ends(found)
    top = spark.createDataFrame(top, f"{NODE.removesuffix(', ends_sha256 string')}, skeleton long")
    known = F.broadcast(top.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("parent"))) if len(skeleton.parent) <= 500_000 else top.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("parent"))
    local = found.where("skeleton is null").join(known, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))
    top = top.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return local.select(*names).unionByName(top.select(*names))


def _summed(found: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """The nodes of the skeleton: what the shards found of them, with what stands below them."""
    parts = found.where("skeleton is not null and ids is null").groupBy("skeleton").agg(F.min("conv_id").alias("low"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("seq").alias("words"))
    got = {r["skeleton"]: [r["low"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["words"]] for r in parts.collect()}
    for k in sorted(got, reverse=True):  # children first
        low, n, kids, leaves, saved, words = got[k]
        got[k][3] = leaves = leaves if kids else 1
        got[k][4] = saved = saved + (n - 1) * words
        if k:
            above = got[skeleton.parent[k]]
            above[0] = low if above[0] is None else min(above[0], low)
            for i, more in enumerate((n, 1, leaves, saved)):
                above[i + 1] += more
    return [(low, skeleton.depth[k], got[skeleton.parent[k]][0] if k else None, n, kids, leaves, saved, k) for k, (low, n, kids, leaves, saved, _) in got.items()]


def _ends(found: DataFrame) -> DataFrame:
    """(skeleton, ends_sha256) of the nodes of the skeleton at which conversations end."""
    out = _arrow("skeleton long, ends_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, done = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    h.update(b"," + ids)
                else:
                    if h:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids)
            if done:
                yield _batch(done, out)
                done = []
        if h:
            yield _batch([(key, h.hexdigest())], out)

    rows = found.where("ids is not null").select("skeleton", "shard", "seq", "ids")
    return rows.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "seq").mapInArrow(run, "skeleton long, ends_sha256 string")


def prefix_trie(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int | None = None, most: int = 4) -> DataFrame:
    """The trie of the conversations as they are, or, with ``family``, as ``rebuilt`` makes them."""
    own = own_turns(turns, key, turn, role, text)
    return nodes(own if family is None else rebuilt(materialize(own), family, most))
