"""A stored inverted-file index for approximate search by inner product.

Vectors are dealt into cells by k-means in two levels, both fitted on bounded samples: first about
the fourth root of n top cells, then each of them into as many as its share of the rows asks for, so
that cells grow as the root of the table and a dense region gets more of them. ``codes``, written
partitioned by cell, holds for each vector its difference from the cell's centre in a byte an
entry; ``vectors``, partitioned the same way, the vectors themselves. A cell that stays large (equal
vectors cannot be parted) is written by several tasks, in files of its own each.

A search tells the nearest cells of each query, reads the codes of those cells alone, keeps the best
KEEP * k by them, and ranks these by their whole vectors. How many cells to look into is measured
when the index is built: as many as hold TARGET of the nearest neighbours of a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorlake.operators.search import ranked
from tutorlake.sources.shared import kept

#: Rows that centres are fitted on: in all for the top cells, and for each cell below them.
SAMPLE, SAMPLE_PER_CELL = 20_000, 64
#: Queries of the sample that the number of cells to look into is measured with, and its aim.
MEASURED, TARGET = 200, 0.97
#: Candidates by codes for each hit, and rows of a part of a cell.
KEEP, PART = 8, 100_000


def _matrix(v: pa.Array) -> np.ndarray:
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(v), len(flat) // max(1, len(v)))


def kmeans(data: np.ndarray, cells: int, seed: int = 3, rounds: int = 10) -> np.ndarray:
    centres = data[np.random.default_rng(seed).permutation(len(data))[:cells]]
    for _ in range(rounds):
        near = nearest(data, centres, 1)[:, 0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(data: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """(rows, k): the nearest centres of each row, nearest first."""
    score = data @ centres.T - 0.5 * (centres**2).sum(1)
    k = min(k, len(centres))
    at = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < len(centres) else np.broadcast_to(np.arange(k), score.shape)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(score, at, 1), axis=1, kind="stable"), 1)


def _sampled(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """About ``most`` of the n vectors, those whose ids hash lowest."""
    some = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30))).select("embedding").limit(2 * most)
    return _matrix(pa.chunked_array([b.column(0) for b in some.toArrow().to_batches()], pa.list_(pa.float32())))


def _probes(sample: np.ndarray, centres: np.ndarray, k: int = 5) -> int:
    """Cells to look into, so that TARGET of the k nearest of sampled vectors are found."""
    asked = sample[:MEASURED]
    score = asked @ sample.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    hits = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.empty((len(asked), len(centres)), np.int64)
    np.put_along_axis(place, nearest(asked, centres, len(centres)), np.arange(len(centres))[None, :].repeat(len(asked), 0), 1)
    ranks = np.sort(np.take_along_axis(place, nearest(sample, centres, 1)[hits][:, :, 0], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))) - 1)]) + 1


def build(chunks: DataFrame, path: str, key: str = "chunk_id", cells: int | None = None) -> None:
    """Writes the index of all vectors that are not null, in about ``cells`` cells (the root of their number)."""
    spark = chunks.sparkSession
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.where("embedding is not null").select(F.col(key).alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    n = rows.count()
    cells = cells or max(1, round(n**0.5))
    sample = _sampled(rows, n, SAMPLE)
    top = kmeans(sample, max(1, round(cells**0.5))) if len(sample) else np.zeros((0, 0), np.float32)
    shared = spark.sparkContext.broadcast(top)

    def in_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = nearest(_matrix(b.column("embedding")), shared.value, 1)[:, 0] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "top"])

    named = kept(rows.mapInArrow(in_top, f"chunk_id {kind}, embedding array<float>, top int"))
    sizes = {r["top"]: r["count"] for r in named.groupBy("top").count().collect()}  # a row for each top cell
    below = {t: max(1, round(cells * c / max(1, n))) for t, c in sizes.items()}
    share = {t: min(1.0, SAMPLE_PER_CELL * below[t] / c) for t, c in sizes.items()}

    def split(table: pa.Table) -> pa.Table:
        t = table.column("top")[0].as_py()
        centres = kmeans(_matrix(table.column("embedding")), below[t])
        return pa.table({"top": pa.array([t] * len(centres), pa.int32()), "centre": pa.array(list(centres), pa.list_(pa.float32()))})

    limits = F.create_map(*(F.lit(x) for t, s in share.items() for x in (t, int(s * (1 << 30))))) if share else None
    drawn = named.where(F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(1 << 30)) < limits[F.col("top")]) if share else named
    found = drawn.groupBy("top").applyInArrow(split, "top int, centre array<float>").collect()  # root of n rows
    found += [(t, top[t].tolist()) for t in set(sizes) - {r["top"] for r in found}]  # of a small cell none may be drawn
    found = sorted((r[0], list(r[1])) for r in found)
    tops, centres = np.array([t for t, _ in found]), np.array([c for _, c in found], np.float32)
    probes = _probes(sample, centres) if len(centres) else 0
    spark.createDataFrame([(i, c, n, probes) for i, (_, c) in enumerate(found)], "cell int, centre array<float>, n long, probes int").coalesce(1).write.parquet(f"{path}/cells")
    known = spark.sparkContext.broadcast((tops, centres))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, centres = known.value
        own = {t: np.flatnonzero(tops == t) for t in np.unique(tops)}
        for b in batches:
            v, top = _matrix(b.column("embedding")), b.column("top").to_numpy()
            cell = np.zeros(len(v), np.int32)
            for t in np.unique(top):
                at = top == t
                cell[at] = own[t][nearest(v[at], centres[own[t]], 1)[:, 0]]
            rest = v - centres[cell]
            scale = np.maximum(np.abs(rest).max(1, initial=0.0), 1e-12) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [b.column("chunk_id"), b.column("embedding"), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale, pa.float32())], names=["chunk_id", "embedding", "cell", "codes", "scale"]
            )

    coded = kept(named.mapInArrow(encode, f"chunk_id {kind}, embedding array<float>, cell int, codes binary, scale float"))
    part = F.pmod(F.xxhash64("chunk_id"), F.greatest(F.lit(1), F.ceil(F.col("size") / PART)))
    held = coded.groupBy("cell").agg(F.count("*").alias("size"))
    coded = coded.join(held, "cell").withColumn("part", part.cast("int")).drop("size").repartition("cell", "part").sortWithinPartitions("cell", "chunk_id")
    coded.select("chunk_id", "codes", "scale", "part", "cell").write.partitionBy("cell").parquet(f"{path}/codes")
    coded.select("chunk_id", "embedding", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")


def candidates(queries: DataFrame, path: str, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, cell, chunk_id): the best KEEP * k of each query by the codes of its nearest cells."""
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # root of n rows
    centres = np.array([r["centre"] for r in cells], np.float32)
    probes = min(len(cells), probes or cells[0]["probes"])
    shared = spark.sparkContext.broadcast(centres)
    codes = spark.read.parquet(f"{path}/codes")
    qkind, kind = queries.schema["query_id"].dataType.simpleString(), codes.schema["chunk_id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest(_matrix(b.column("embedding")), shared.value, probes)
            at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("embedding").take(at), pa.array(near.ravel().astype(np.int32))], names=["query_id", "embedding", "cell"])

    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    asked = kept(asked.mapInArrow(probe, f"query_id {qkind}, embedding array<float>, cell int"))
    wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]
    codes = codes.where(F.col("cell").isin(wanted))
    parts = codes.select("cell", F.col("part").alias("piece")).distinct()
    asked = asked.join(parts, "cell")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": left.column("query_id").combine_chunks(), "chunk_id": right.column("chunk_id").combine_chunks()}
        i = j = np.zeros(0, np.int64)
        score, cell = np.zeros(0), 0
        if left.num_rows and right.num_rows:
            cell = right.column("cell")[0].as_py()
            q = _matrix(left.column("embedding"))
            c = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.int8).reshape(right.num_rows, -1).astype(np.float32)
            s = (q @ c.T) * right.column("scale").to_numpy()[None, :] + (q @ shared.value[cell])[:, None]
            m = min(KEEP * k, s.shape[1])
            at = np.argpartition(-s, m - 1, axis=1)[:, :m]
            i, j = np.repeat(np.arange(len(q)), m), at.ravel()
            score = s[i, j].astype(np.float64)
        return pa.table({"query_id": out["query_id"].take(pa.array(i)), "cell": pa.array(np.full(len(i), cell, np.int32)), "chunk_id": out["chunk_id"].take(pa.array(j)), "score": pa.array(score)})

    found = asked.groupBy("cell", "piece").cogroup(codes.groupBy("cell", "part")).applyInArrow(best, f"query_id {qkind}, cell int, chunk_id {kind}, score double")
    return ranked(found, F.col("score"), KEEP * k, "chunk_id").select("query_id", "cell", "chunk_id")


def topk(queries: DataFrame, path: str, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score): approximate top k by inner product."""
    spark = queries.sparkSession
    if spark.read.parquet(f"{path}/cells").isEmpty():
        return queries.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("chunk_id"), F.lit(0.0).alias("score"))
    near = kept(candidates(queries, path, k, probes))
    wanted = [r["cell"] for r in near.select("cell").distinct().collect()]
    vectors = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(wanted))
    rows = vectors.join(near, ["cell", "chunk_id"]).select("query_id", "chunk_id", F.col("embedding").alias("other"))
    rows = rows.join(queries.select("query_id", "embedding"), "query_id")

    @F.pandas_udf("double")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        return pd.Series(np.round((np.stack(a.to_numpy()).astype(np.float64) * np.stack(b.to_numpy())).sum(1), 6))

    rows = rows.select("query_id", "chunk_id", product("embedding", "other").alias("score"))
    return ranked(rows, F.col("score"), k, "chunk_id").select("query_id", "rank", "chunk_id", "score")
