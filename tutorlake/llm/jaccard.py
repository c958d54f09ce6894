"""N-gram Jaccard join: near-duplicate texts by their sets of word shingles, exactly.

Two sets link when 100 * intersection >= percent * union; a class is what links connect.

1. Every text becomes a set of hashed shingles, its size, a signature of the whole set and a
   bitmap of hashed bits. Equal sets are one node from here on.
2. Sets that link share k shingles among the first n - ceil(n * percent / 100) + k of any common
   order, for every k; here k grows with the size. The order puts shingles that are frequent
   (found by counting in slices, summed by Spark; the list is bounded and any list gives right
   results) last, so passages that many texts share make no groups. A set that shares fewer of
   its first shingles with any other than a link needs has none and drops out, and so on while
   this frees others; what stays is nearly only what links.
3. Each shingle's group is sorted by size. A set is paired with the one that stands before it in
   the most of its groups and with the one that leads the most of them. Sizes and bitmaps bound
   the intersection from above; what may link is verified by intersecting the sorted arrays.
   Links give classes.
4. Groups that still hold more than one class, sorted by size, are cut into tiles: a tile meets
   those within its size band, compared as bitmaps all at once. Here a group takes the sets that
   have its shingle among their first n - ceil(n * percent / 100) + 1, as linked sets share one of
   those. A row carries the shingles before its own, so that a pair with one of them in common
   is not told again: it was met there. First each row tells its closest partner of another class,
   and classes are built anew; then all pairs of two classes that the bounds allow are told.
   Those not tried before are verified, and classes are built again. After that, no link is
   missing: each one lies inside a class or was tried.

A task holds the tiles of a size band of a group, 200 bytes a row; groups are never expanded to all
pairs of copies, and nothing of the corpus but the bounded list of frequent shingles reaches the
driver. Null texts count as empty; a text without words links with nothing. Repeated rows count
as equal sets; an empty table gives no row; other columns are never looked at. Texts of any length
are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorlake.llm import shingles
from tutorlake.llm.common import keyed, map_columns, materialize, small_side, unused

WORDS = 5
PERCENT = 80
BITS = 1024
#: At most so many frequent shingles are listed (8 bytes each), the most frequent first.
FREQUENT = 1 << 17
#: Rows of a tile compared at once.
BLOCK = 1024
#: One in so many shingles of a set must be shared among the first ones.
SHARE = 5
#: Rounds of dropping sets; more change no result.
ROUNDS = 2
#: Shingles before its own that a row of a tile carries; any number gives the same pairs.
BEFORE = 6


def signature(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(s >> np.uint64(40)).astype(np.int64) % BITS] = True
    return np.packbits(bits).tobytes()


def nodes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, sig, bits, common): the set of each text in short; ``common`` holds, on the first
    row of a slice, shingles that recur in the slice."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(c):
        got = shingles.sets(c["text"], words)
        sigs = [signature(s) for s in got]
        once = list({g: s for g, s in zip(sigs, got)}.values())
        seen, n = np.unique(np.concatenate(once), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0))
        often = n >= 3
        common = [[{"h": h, "n": k} for h, k in zip(seen[often].astype(np.int64).tolist(), n[often].tolist())]]
        return {"doc_id": c["doc_id"], "n": [len(s) for s in got], "sig": sigs, "bits": [bitmap(s) for s in got], "common": common + [None] * (len(got) - 1)}

    return map_columns(docs, f"doc_id {kind}, n int, sig long, bits binary, common array<struct<h:long,n:int>>", "text", lambda: run)


def _shared_least(n):
    """Shingles that two linked sets, the smaller of n, share among the first of both, at least."""
    return n // SHARE + 1


def _prefixes(docs: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """(token, sig, n, early): the prefix of each set, rare shingles first; ``early`` marks those of
    which linked sets share at least one."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        often = shared.value

        def run(c):
            token, sig, size, early = [], [], [], []
            done = set()
            for s in shingles.sets(c["text"], words):
                g = signature(s)
                if not len(s) or g in done:
                    continue
                done.add(g)
                one = len(s) - (len(s) * percent + 99) // 100 + 1
                take = min(len(s), one - 1 + _shared_least(len(s)))
                if len(often):
                    at = np.searchsorted(often, s)
                    hit = often[np.minimum(at, len(often) - 1)] == s
                    if hit.any():
                        s = np.concatenate([s[~hit], s[hit]])
                token.append(s[:take].astype(np.int64))
                sig.append(np.full(take, g, np.int64))
                size.append(np.full(take, len(s), np.int32))
                early.append(np.arange(take) < one)
            joined = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            return {"token": joined(token, np.int64), "sig": joined(sig, np.int64), "n": joined(size, np.int32), "early": joined(early, bool)}

        return run

    return map_columns(docs.select("text"), "token long, sig long, n int, early boolean", "text", make)


def _thin(groups: DataFrame, percent: int) -> DataFrame:
    """Without the sets that have too few rows for a link, and the groups that hold one set then."""
    smallest = F.floor((F.col("n") * percent + 99) / 100)  # of a partner
    enough = groups.groupBy("sig", "n").agg(F.count("*").alias("c")).where(F.col("c") >= F.floor(smallest / SHARE) + 1).select("sig")
    return _grouped(groups.join(small_side(enough), "sig", "left_semi").select("token", "sig", "n", "early"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows (token, sig, n, early) of tokens with two sets or more, each set once, with the set before
    it by size and the first one."""
    by_size = Window.partitionBy("token").orderBy("n", "sig")
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "token", "sig", "n", "early", F.lag("sig").over(by_size).alias("prev"), F.lag("n").over(by_size).alias("n_prev"), F.first("sig").over(whole).alias("head"), F.first("n").over(whole).alias("n_head"), F.last("sig").over(whole).alias("tail")
    )
    return rows.where("head <> tail and not (sig <=> prev)").drop("tail")


def may_link(n_a, n_b, percent: int):
    """Sizes alone allow a link."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def verify(pairs: DataFrame, table: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the pairs of signatures that link: bitmaps first, then the sorted arrays."""
    short = table.select("sig", "n", "bits")
    both = pairs.join(short.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    both = both.join(short.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")

    def bound(c):
        a, b = (np.frombuffer(b"".join(c[k]), np.uint8).reshape(-1, BITS // 8) for k in ("bits_a", "bits_b"))
        apart = np.bitwise_count(a ^ b).sum(1).astype(np.int64)
        total = np.array(c["n_a"], np.int64) + np.array(c["n_b"], np.int64)
        ok = (total - apart) * (100 + percent) >= 2 * percent * total
        return {"a": np.array(c["a"], np.int64)[ok], "b": np.array(c["b"], np.int64)[ok]}

    near = map_columns(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), "a long, b long", "bits_a", lambda: bound)
    near = near.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a")
    near = near.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b")

    def exact(c):
        ok = []
        for s, t in zip(shingles.sets(c["text_a"], words), shingles.sets(c["text_b"], words)):
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= percent * (len(s) + len(t) - both))
        return {k: [x for x, y in zip(c[k], ok) if y] for k in ("a", "b")}

    return map_columns(near.select("a", "b", "text_a", "text_b"), "a long, b long", "text_a", lambda: exact)


def signed_texts(docs: DataFrame, table: DataFrame, words: int) -> DataFrame:
    """(sig, text): for each set of ``table`` (sig, first) one text that has it."""
    texts = docs.join(small_side(table.select(F.col("first").alias("doc_id"))), "doc_id", "left_semi")
    signed = lambda c: {"sig": [signature(s) for s in shingles.sets(c["text"], words)], "text": c["text"]}
    texts = map_columns(texts.select("text"), "sig long, text string", "text", lambda: signed)
    return materialize(texts.join(table.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]))


def named(links: DataFrame, table: DataFrame) -> DataFrame:
    """Links (a, b) of signatures as links of the first keys that have them."""
    first = table.select("sig", "first")
    both = links.join(first.select(F.col("sig").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("sig").alias("b"), F.col("first").alias("fb")), "b")
    return both.select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def classes(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) connect each node with. Minima travel
    along links and labels are followed to their own label, so rounds grow with the logarithm of
    a chain's length; each round is written to the shared folder."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
    both = materialize(both.where("node <> to").distinct())
    label = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("low"))
        step = label.join(near, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "was"))
        if step.where("label <> was").isEmpty():
            return step.select("node", "label")
        label = step.select("node", "label")


def _partners(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the one that precedes it in the most groups, and with the one that
    leads the most of its groups; two pairs a set at most."""
    found = []
    for to, n in (("prev", "n_prev"), ("head", "n_head")):
        rows = groups.where(may_link(F.col("n"), F.col(n), percent)).where(F.col("sig") != F.col(to))
        often = rows.groupBy("sig", F.col(to).alias("to")).agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", "to"))["to"].alias("to"))
        found.append(often.select(F.least("sig", "to").alias("a"), F.greatest("sig", "to").alias("b")))
    return found[0].unionByName(found[1]).distinct()


def _looking_back(groups: DataFrame) -> DataFrame:
    """The early rows of the groups, each with the BEFORE early shingles of its set before its own."""
    w = Window.partitionBy("sig").orderBy("token")
    before = [F.coalesce(F.lag("token", i + 1).over(w), F.lit(0)).alias(f"t{i}") for i in range(BEFORE)]
    return groups.where("early").select("token", "sig", *before)


def _tiles(rows: DataFrame, percent: int, closest: bool) -> DataFrame:
    """(a, b) of two classes whose sizes and bitmaps allow a link, from groups that hold two classes
    or more; with ``closest``, the nearest partner of each row only.

    ``rows`` has token, sig, n, bits, label and the shingles before. A group comes sorted by size and
    is cut into tiles of BLOCK rows; a tile meets itself and those before it whose size band it
    reaches. A pair that shares one of the shingles before has met in that one's group."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rows = rows.select("token", "sig", "n", "bits", F.xxhash64("label").alias("label"), *(f"t{i}" for i in range(BEFORE)))
    w = Window.partitionBy("token").orderBy("n", "sig").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", F.min("label").over(w).alias("lo"), F.max("label").over(w).alias("hi")).where("lo <> hi").drop("lo", "hi")
    rows = rows.sortWithinPartitions("token", "n", "sig")  # where the window left each group whole

    def compare(home, other, same):
        bits = np.bitwise_count(home["bits"][:, None, :] ^ other["bits"][None, :, :]).sum(2, dtype=np.int64)
        total = home["n"][:, None] + other["n"][None, :]
        ok = ((total - bits) * (100 + percent) >= 2 * percent * total) & (home["label"][:, None] != other["label"][None, :])
        ok &= home["n"][:, None] * 100 >= other["n"][None, :] * percent
        if same:
            ok = np.triu(ok, 1)
        if closest:
            j = np.flatnonzero(ok.any(0))
            i = np.where(ok[:, j], bits[:, j], 1 << 40).argmin(0)
        else:
            i, j = np.nonzero(ok)
        if len(i):
            x, y = home["before"][i], other["before"][j]
            new = ~((x[:, :, None] == y[:, None, :]) & (x[:, :, None] != 0)).any((1, 2))
            i, j = i[new], j[new]
        a, b = home["sig"][i], other["sig"][j]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tiles = None, []  # tiles of the group that is being read, as far as they reach
        for batch in batches:
            long = lambda k, b=batch: b.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
            token, n, sig, label = map(long, ("token", "n", "sig", "label"))
            before = np.stack([long(f"t{i}") for i in range(BEFORE)], 1)
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(token), -1)
            cuts = np.flatnonzero(token[1:] != token[:-1]) + 1
            found = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(token)]):
                if s < e and key != token[s]:
                    key, tiles = token[s], []
                for lo in range(s, e, BLOCK):
                    hi = min(e, lo + BLOCK)
                    now = {"sig": sig[lo:hi], "n": n[lo:hi], "label": label[lo:hi], "bits": bits[lo:hi], "before": before[lo:hi]}
                    tiles = [t for t in tiles if t["n"][-1] * 100 >= now["n"][0] * percent]
                    found += [compare(t, now, False) for t in tiles]
                    if hi - lo > 1:
                        found.append(compare(now, now, True))
                    tiles.append(now)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(2)], schema=out)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is the smallest key of the class."""
    docs = keyed(df, key, text)
    short = materialize(nodes(docs, words))
    counted = short.where("common is not null").select(F.inline("common")).groupBy("h").agg(F.sum("n").alias("n")).where("n >= 16")
    frequent = np.sort(np.array([r["h"] for r in counted.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").collect()], np.int64).view(np.uint64))
    sets_of = short.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("first"), F.first("bits").alias("bits"))

    groups = materialize(_grouped(_prefixes(docs, frequent, words, percent)))
    for _ in range(ROUNDS):
        groups = materialize(_thin(groups, percent))
    pairs = materialize(_partners(groups, percent))

    grouped = groups.select("sig").distinct()
    table = materialize(sets_of.join(grouped, "sig", "left_semi"))
    texts = signed_texts(docs, table, words)

    links = materialize(verify(pairs, table, texts, words, percent))
    label = classes(named(links, table))
    back = _looking_back(groups)
    for closest in (True, False):
        of_sig = table.join(label.withColumnRenamed("node", "first"), "first", "left").select("sig", "n", "bits", F.coalesce("label", "first").alias("label"))
        more = _tiles(back.join(of_sig, "sig"), percent, closest)
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"))
        found = materialize(verify(more, table, texts, words, percent))
        if not found.isEmpty():
            links = links.unionByName(found)
            label = classes(named(links, table))
        pairs = pairs.unionByName(more)
    final = sets_of.join(label.withColumnRenamed("node", "first"), "first", "left").select("sig", F.col("n").alias("m"), F.coalesce("label", "first").alias("component_id"))
    # from a table, so that a signature with very many copies can be split in the join
    final = materialize(final)
    got = short.select("doc_id", "n", "sig").join(final, (F.col("n") == F.col("m")) & (short["sig"] == final["sig"]), "left")
    return got.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose key is the smallest of its class; rows without a key stay."""
    copy = unused(df, "copy")
    gone = components(df, key, text, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(copy)).distinct()
    return df.join(small_side(gone), F.col(key) == F.col(copy), "left_anti")
