"""Circulant MinHash: near-duplicate texts by banded signatures of two permutations, then exactly.

Two sets link when 100 * intersection >= percent * union; a class is what links connect.

1. A text is the set of its word shingles, in a universe of 2**32 places. One permutation of the
   universe scatters the set; a second one, shifted circularly by k places, gives coordinate k of
   the signature as the smallest place that it sends the set to. ROWS coordinates make a band.
   Equal sets (by a 64-bit hash of all shingles) are one node from here on.
2. Sets that agree in a band are in one bucket. At 0.85 two sets agree in none of the 24 bands of
   four with a probability of 2e-8. Sets so small that only equal ones can link have no bands.
3. A bucket's smallest and largest set by hash are its pivots, found by partial aggregation; every
   set is paired with the pivots that it meets in the most buckets. Pairs pass a bound of their
   intersection by hashed bitmaps, then the whole sets are intersected. Links give classes.
4. In buckets that still hold more than one class, sets of different classes meet: a bucket is cut
   into parts of about PART sets, and each two of its parts make a cell of their own, so that cells
   are bounded and a large bucket is many of them. First each set tells its closest partner in a
   cell, and classes are built anew; then all pairs of two classes that bound and sizes allow.

Candidates are never capped. Nothing of the corpus reaches the driver. Null texts count as empty; a
text without words links with nothing. Repeated rows are equal sets; an empty table gives no row;
other columns are never looked at. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlake.llm import jaccard, shingles
from tutorlake.llm.common import keyed, map_columns, materialize

WORDS = 5
PERCENT = 85
BANDS, ROWS = 24, 4
#: Sets in a part of a large bucket, about.
PART = 512
#: Places hashed at once, so that they stay in a core's cache.
BLOCK = 1 << 16

# Odd multipliers of the two permutations of 32-bit places (fixed values of this module).
_SCATTER = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_SECOND = (np.uint32(0x7FEB352D), np.uint32(0x846CA68B))


def _permute(x: np.ndarray, by: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A permutation of the 32-bit numbers: xors with shifted copies and odd multiples."""
    x = (x ^ (x >> np.uint32(16))) * by[0]
    x = (x ^ (x >> np.uint32(15))) * by[1]
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """(sets, size): the coordinates of each set, none of which is empty."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    lengths = [len(s) for s in sets]
    i = 0
    while i < len(sets):  # as many sets at once as fit in a block; a larger one in pieces
        j, total = i + 1, lengths[i]
        while j < len(sets) and total + lengths[j] <= BLOCK:
            total += lengths[j]
            j += 1
        places = np.concatenate(sets[i:j])
        places = _permute((places >> np.uint64(32)).astype(np.uint32) ^ places.astype(np.uint32), _SCATTER)
        for lo in range(0, len(places), BLOCK) if j == i + 1 else (0,):
            part = places[lo : lo + BLOCK] if j == i + 1 else places
            starts = np.cumsum([0, *lengths[i : j - 1]]) if j > i + 1 else [0]
            for k in range(size):
                low = np.minimum.reduceat(_permute(part - np.uint32(k), _SECOND), starts)
                np.minimum(out[i:j, k], low, out=out[i:j, k])
        i = j
    return out


def bands(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands): a 64-bit hash of each band and its number."""
    with np.errstate(over="ignore"):
        parts = coordinates.astype(np.uint64).reshape(len(coordinates), -1, rows)
        h = np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            h = shingles.mix(h + parts[:, :, r])
        return h.view(np.int64)


def least_size(percent: int) -> int:
    """Smaller sets can only link with equal ones: n of n + 1 is under percent."""
    return next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62


def nodes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, bits, bands) of each text; the last two only on the first row of equal sets in a slice."""
    kind, least = docs.schema["doc_id"].dataType.simpleString(), least_size(percent)

    def run(c):
        got = shingles.sets(c["text"], words)
        sigs = [jaccard.signature(s) for s in got]
        first, bits, tokens = {}, [None] * len(got), [None] * len(got)
        for i, g in enumerate(sigs):
            first.setdefault(g, i)
        large = [i for i in first.values() if len(got[i]) >= least]
        for i, b in zip(large, bands(signatures([got[i] for i in large]))):
            bits[i], tokens[i] = jaccard.bitmap(got[i]), b.tolist()
        return {"doc_id": c["doc_id"], "n": [len(s) for s in got], "sig": sigs, "bits": bits, "bands": tokens}

    return map_columns(docs, f"doc_id {kind}, n int, sig long, bits binary, bands array<long>", "text", lambda: run)


def _pivots(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the first and the last pivot that it meets in the most buckets."""
    found = []
    for pivot in ("low", "high"):
        rows = groups.where(F.col("sig") != F.col(f"{pivot}.sig")).where(jaccard.may_link(F.col("n"), F.col(f"{pivot}.n"), percent))
        often = rows.groupBy("sig", F.col(f"{pivot}.sig").alias("to")).agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", "to"))["to"].alias("to"))
        found.append(often.select(F.least("sig", "to").alias("a"), F.greatest("sig", "to").alias("b")))
    return found[0].unionByName(found[1]).distinct()


def _mixed(groups: DataFrame, label: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (token, sig, n, bits, label, i, j, side) of the buckets with two classes or more, in cells:
    i and j are the parts that meet, side tells which of the two a set is in."""
    known = table.join(label.withColumnRenamed("node", "first"), "first", "left").select("sig", "bits", F.xxhash64(F.coalesce("label", "first")).alias("label"))
    rows = groups.select("token", "sig", "n").join(known, "sig")
    mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    parts = F.ceil(F.col("size") / PART).cast("int")
    rows = rows.join(mixed.select("token", parts.alias("parts")), "token").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("token", "sig", "n", "bits", "label", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"))


def _met(rows: DataFrame, percent: int, closest: bool) -> DataFrame:
    """(a, b) of sets of two classes that meet in a cell and may link; with ``closest``, the nearest
    partner of each set only. Rows of a batch are compared at growing distance, all cells at once."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "sig")

    def compare(cell, same, sig, n, bits, label, side):
        size = np.diff(np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)))
        best = np.full(len(cell), np.iinfo(np.int64).max)
        pairs = []
        for o in range(1, int(size.max(initial=1))):
            x = np.flatnonzero((cell[o:] == cell[:-o]) & (label[o:] != label[:-o]) & (same[o:] | (side[o:] != side[:-o])))
            if not len(x):
                continue
            y = x + o
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            total = small + large
            ok = (small * 100 >= large * percent) & ((total - apart) * (100 + percent) >= 2 * percent * total)
            x, y, apart = x[ok], y[ok], apart[ok]
            if closest:
                best[x] = np.minimum(best[x], (apart << 32) | y)
                best[y] = np.minimum(best[y], (apart << 32) | x)
            else:
                pairs.append((x, y))
        if closest:
            x = np.flatnonzero(best != np.iinfo(np.int64).max)
            pairs.append((x, best[x] & 0xFFFFFFFF))
        x, y = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in range(2))
        return np.minimum(sig[x], sig[y]), np.maximum(sig[x], sig[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the last cell of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            key = np.stack([table.column(k).to_numpy().astype(np.int64) for k in ("token", "i", "j")], 1)
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            left = table.slice(int(starts[-1]))
            yield from done(table.slice(0, int(starts[-1])))
        if left is not None:
            yield from done(left)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        long = lambda k: table.column(k).to_numpy().astype(np.int64)
        key = np.stack([long(k) for k in ("token", "i", "j")], 1)
        cell = np.cumsum(np.append(0, (key[1:] != key[:-1]).any(1)))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(cell), -1)
        a, b = compare(cell, key[:, 1] == key[:, 2], long("sig"), long("n"), bits, long("label"), long("side"))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; the component is the smallest key of the class."""
    docs = keyed(df, key, text)
    short = materialize(nodes(docs, words, percent))
    sets_of = short.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("first"), F.min("bits").alias("bits"), F.min("bands").alias("bands"))
    sets_of = materialize(sets_of)

    rows = sets_of.select("sig", "n", F.explode("bands").alias("token"))
    one = F.struct(F.xxhash64("sig"), "sig", "n")
    heads = rows.groupBy("token").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low.sig <> high.sig")
    groups = materialize(rows.join(heads.select("token", F.struct("low.sig", "low.n").alias("low"), F.struct("high.sig", "high.n").alias("high")), "token"))
    pairs = materialize(_pivots(groups, percent))

    table = materialize(sets_of.join(groups.select("sig").distinct(), "sig", "left_semi").drop("bands"))
    texts = jaccard.signed_texts(docs, table, words)
    links = materialize(jaccard.verify(pairs, table, texts, words, percent))
    label = jaccard.classes(jaccard.named(links, table))
    for closest in (True, False):
        more = _met(_mixed(groups, label, table), percent, closest)
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"))
        found = materialize(jaccard.verify(more, table, texts, words, percent))
        if not found.isEmpty():
            links = links.unionByName(found)
            label = jaccard.classes(jaccard.named(links, table))
        pairs = pairs.unionByName(more)
    final = materialize(sets_of.join(label.withColumnRenamed("node", "first"), "first", "left").select("sig", F.col("n").alias("m"), F.coalesce("label", "first").alias("component_id")))
    got = short.select("doc_id", "n", "sig").join(final, (F.col("n") == F.col("m")) & (short["sig"] == final["sig"]), "left")
    component = F.coalesce("component_id", "doc_id")
    return got.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
