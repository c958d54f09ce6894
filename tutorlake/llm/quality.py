"""Quality classifier: supervised subword embeddings.

Words and character n-grams of a text, case and marks kept, are hashed to learned vectors; a text
is the average of its vectors, followed by a softmax over the two labels. Vectors and output
weights are trained by plain stochastic gradient descent in numpy on at most ``rows_per_label``
labelled rows of each label (those with the smallest hash of the key); the shares of the labels,
counted over all rows that may be learned from, correct for the even sample. Only hashed counts
reach the driver. In use the model is one number for each bucket, so a corpus is scored in one
pass without a shuffle.

Rows held out (crc32 of the key, modulo 3, is 1) and rows without a label 0 or 1 are never learned
from. Null and empty texts have no vector and score 0; so does everything when a label is missing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorlake.llm import grams
from tutorlake.llm.common import held_out, map_columns, sample_order

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
ROWS_PER_LABEL = 1000
SIZE, RATE, EPOCHS = 8, 1.0, 8


def _features(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Word starts and buckets, n-gram buckets by order, which positions count, starts of texts.
    A word's second vector is that of the pair with the word before; equal pairs share one."""
    code, starts = grams.codes(texts)
    at, h = grams.words(code)
    pair = np.empty_like(h)
    pair[:1] = 0
    with np.errstate(over="ignore"):
        pair[1:] = np.where(h[1:] == h[:-1], np.uint64(1), h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    first = np.searchsorted(at, starts)
    pair[first[first < len(pair)]] = 0  # the word before is another text's
    spread = (pair ^ (pair >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return at, [(h >> shift).astype(np.int32), (spread >> shift).astype(np.int32)], [grams.hashed(code, n, BUCKETS) for n in ORDERS], (code > 32, starts)


def _counts(texts: list[str]):
    at, by_word, by_char, (solid, starts) = _features(texts)
    ends = [*starts[1:].tolist(), len(solid)]
    cut = np.searchsorted(at, [*starts, len(solid)])
    for i, (s, e) in enumerate(zip(starts.tolist(), ends)):
        parts = [b[s:e][solid[s:e]] for b in by_char] + [w[cut[i] : cut[i + 1]] for w in by_word]
        yield np.unique(np.concatenate(parts), return_counts=True)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows_per_label: int = ROWS_PER_LABEL, seed: int = 11) -> dict | None:
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out("doc_id") & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return None
    # about twice as many rows as asked for go on to the ranking, however many a label has
    near = known.withColumn("h", sample_order("doc_id")).where(F.col("h") <= F.when(F.col("label") == 1, 2 * rows_per_label / shares[1]).otherwise(2 * rows_per_label / shares[0]))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))
    picked = near.withColumn("r", rank).where(F.col("r") <= rows_per_label).select("doc_id", "label")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(picked), "doc_id").select("label", "text")  # at most 2 x rows_per_label keys
    run = lambda c: dict(zip(("label", "buckets", "counts"), zip(*((l, *x) for l, x in zip(c["label"], _counts(c["text"])))))) if c["label"] else {"label": [], "buckets": [], "counts": []}  # noqa: E731, E741
    got = map_columns(rows, "label int, buckets array<int>, counts array<int>", "text", lambda: run).toPandas()
    data = [(np.asarray(b, np.int64), np.asarray(c, np.float32) / np.sum(c), int(l)) for l, b, c in zip(got["label"], got["buckets"], got["counts"]) if len(b)]  # noqa: E741
    data.sort(key=lambda x: (len(x[0]), x[2], x[0][:8].tolist()))
    if len({d[2] for d in data}) < 2:
        return None
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    out, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    steps = EPOCHS * len(data)
    for epoch in range(EPOCHS):
        for j, i in enumerate(rng.permutation(len(data))):
            buckets, share, y = data[i]
            rate = np.float32(RATE * (1 - (epoch * len(data) + j) / steps))
            hidden = share @ vectors[buckets]
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.1) * p
            vectors[buckets] -= (rate * len(buckets) ** 0.5) * share[:, None] * back
    seen = np.bincount([d[2] for d in data], minlength=2)
    prior = np.log(shares[1] / shares[0]) - np.log(seen[1] / seen[0])
    return {"table": (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0] + prior)}


def score(df: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; the model is a broadcast of BUCKETS numbers."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(c):
            texts = c["text"]
            p = np.zeros(len(texts))
            if m is not None and texts:
                at, by_word, by_char, (solid, starts) = _features(texts)
                total = m["table"][by_char[0]]
                for b in by_char[1:]:
                    total += m["table"][b]
                total *= solid
                for w in by_word:
                    total[at] += m["table"][w]
                n = len(ORDERS) * grams.per_text(solid.astype(np.int64), starts) + len(by_word) * np.diff(np.searchsorted(at, [*starts, len(solid)]))
                logit = grams.per_text(total.astype(np.float64), starts) / np.maximum(n, 1) + m["bias"]
                p = np.where(n > 0, 1 / (1 + np.exp(-np.clip(logit, -60, 60))), 0.0)
            return {"doc_id": c["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return run

    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_columns(rows, f"doc_id {kind}, score double, predicted int", "text", make)
