"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, what is no letter becomes a space, and its character n-grams (1 to 3) are
hashed. Term frequencies are shares of the text's n-grams; document frequencies are counted over
all rows that may be learned from. The model is trained by follow-the-regularised-leader with
elastic-net penalties (most weights end as zero) on at most ``rows_per_lang`` labelled rows of
each language, those with the smallest hash of the key; one in five of them is kept back to fit
the temperature that calibrates the probabilities. Only their hashed counts reach the driver.

Rows held out (crc32 of the key, modulo 3, is 1) and rows without a label are never learned from.
Texts that are null or have no letter get ``und`` and score 0, as does everything when there is
nothing to learn from. No row is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorlake.llm import grams
from tutorlake.llm.common import held_out, keyed, map_columns, sample_order, slices, small_side

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ROWS_PER_LANG = 600
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 0.1, 0.02, 0.01, 4, 10.0
#: Characters that are classified at once (about 30 bytes each).
CLASSIFIED = 250_000


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Buckets by order, which windows hold a letter, starts, and whether each text has letters."""
    code, starts = grams.codes([t.lower() for t in texts])
    alpha = grams.letters()[np.minimum(code, 0x10FFFF)]
    code = np.where(alpha, code, np.uint32(32))
    has = grams.per_text(alpha.astype(np.int64), starts)
    return [grams.hashed(code, n, BUCKETS) for n in ORDERS], alpha, starts, has


def _counts(texts: list[str]):
    """(buckets, counts) of each text."""
    rows, alpha, starts, _ = _grams(texts)
    ends = [*starts[1:].tolist(), len(alpha)]
    for s, e in zip(starts.tolist(), ends):
        keep = alpha[s:e]
        yield np.unique(np.concatenate([r[s:e][keep] for r in rows]), return_counts=True)


def learnable(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    df = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return df.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Of every bucket, over all rows: counted in the partitions, summed by Spark; the result has
    at most BUCKETS rows."""

    def make():
        def run(c):
            df = np.zeros(BUCKETS + 1, np.int64)
            for at in range(0, len(c["text"]), 200):
                buckets, alpha, starts, _ = _grams(c["text"][at : at + 200])
                of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(alpha))))[alpha]
                seen = np.zeros((len(starts), BUCKETS), bool)
                for b in buckets:
                    seen[of, b[alpha]] = True
                df[:-1] += np.count_nonzero(seen, axis=0)
            df[-1] = len(c["text"])
            hit = np.flatnonzero(df)
            return {"bucket": hit.astype(np.int32), "n": df[hit]}

        return run

    got = map_columns(rows.select("text"), "bucket int, n long", "text", make).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return df[:-1], int(df[-1])


def sample(rows: DataFrame, most: int) -> list:
    """(lang, buckets, counts) of at most ``most`` rows a language; ties of the hash included
    only as far as the bound goes."""
    order = sample_order("doc_id")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # about twice as many rows as asked for go on to the ranking, however many a language has
    near = rows.select("lang", "doc_id", order.alias("h")).join(small_side(counts), "lang").where(F.col("h") <= 2 * most / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    last = near.select("lang", "h", rank.alias("r")).where(F.col("r") <= most).groupBy("lang").agg(F.max("h").alias("h")).collect()
    if not last:
        return []
    limit = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(r["h"])) for r in last))
    picked = rows.where(order <= limit).select("lang", "text")
    run = lambda c: dict(zip(("lang", "buckets", "counts"), zip(*((l, *x) for l, x in zip(c["lang"], _counts(c["text"])))))) if c["lang"] else {"lang": [], "buckets": [], "counts": []}  # noqa: E731, E741
    got = map_columns(picked, "lang string, buckets array<int>, counts array<int>", "text", lambda: run).toPandas()
    return sorted(((l, b, n) for l, b, n in zip(got["lang"], got["buckets"], got["counts"])), key=lambda x: (len(x[1]), x[0], tuple(x[1][:8])))  # noqa: E741


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader for a multinomial model; the last feature is the bias."""

    def __init__(self, features: int, classes: int):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / ALPHA
        self.z[rows] += g - sigma * w
        self.n[rows] += g * g


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = ROWS_PER_LANG, seed: int = 7) -> dict | None:
    """Languages, a weight for each bucket and language (idf folded in), bias and temperature."""
    rows = learnable(df, key, text, lang)
    got = sample(rows, rows_per_lang)
    if not got:
        return None
    df_of, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df_of)) + 1
    langs = sorted({g[0] for g in got})
    make = lambda b, c: (np.append(b, BUCKETS), np.append(SCALE * idf[b] * c / max(1, c.sum()), 1.0))
    data = [(*make(np.asarray(b, np.int64), np.asarray(c, float)), langs.index(l)) for l, b, c in got]  # noqa: E741
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    kept, fit = order[::5] if len(order) >= 20 else order, order if len(order) < 20 else np.delete(order, np.s_[::5])
    model = Ftrl(BUCKETS, len(langs))
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            model.learn(*data[i])
    w = model.weights(slice(None))
    logits = np.array([data[i][1] @ w[data[i][0]] for i in kept])
    labels = np.array([data[i][2] for i in kept])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return {"langs": langs, "table": (SCALE * idf[:, None] * w[:-1]).astype(np.float32), "bias": w[-1], "temperature": float(grid[int(np.argmin(loss))])}


def _classify(model: dict | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    if model is None or not texts:
        return ["und"] * len(texts), np.zeros(len(texts))
    buckets, alpha, starts, has = _grams(texts)
    logits = np.empty((len(texts), len(model["langs"])))
    for k in range(len(model["langs"])):
        column = np.ascontiguousarray(model["table"][:, k])
        total = column[buckets[0]]
        for b in buckets[1:]:
            total += column[b]
        total *= alpha
        logits[:, k] = grams.per_text(total.astype(np.float64), starts)
    p = softmax((logits / (len(ORDERS) * np.maximum(has, 1))[:, None] + model["bias"]) / model["temperature"])
    names = [model["langs"][b] if n else "und" for b, n in zip(p.argmax(1).tolist(), has.tolist())]
    return names, np.where(has > 0, p.max(1), 0.0)


def predict(df: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row. The model goes to the executors as a broadcast of
    BUCKETS x languages numbers, whatever the corpus."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(c):
        names, score = _classify(shared.value, c["text"])
        return {"doc_id": c["doc_id"], "lang_pred": names, "score": score}

    return map_columns(keyed(df, key, text), f"doc_id {kind}, lang_pred string, score double", "text", lambda: run)


def sliced(model: dict | None):
    """A function from an Arrow array of texts to their languages and probabilities, which holds a
    slice of them at a time as Python strings."""

    def of(texts: pa.Array) -> pa.Array:
        names, score = [], [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", CLASSIFIED):
            got = _classify(model, [t or "" for t in part.column("text").to_pylist()])
            names += got[0]
            score.append(got[1])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(score))], names=["lang_pred", "score"])

    return of


def language(df: DataFrame, model: dict | None, text: str = "text") -> Column:
    """The prediction as a column (lang_pred, score) of ``df``, to filter rows without a join."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        return sliced(shared.value)(texts)

    return of(F.col(text))
