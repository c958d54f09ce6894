"""Stored indexes give what a search without them gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tutorlake.functions import normalize as N
from tutorlake.operators import keyword_index as KI
from tutorlake.operators import keyword_scan as KS
from tutorlake.operators import search as R
from tutorlake.operators import vector_index as VI
from tutorlake.plans import q_search
from tutorlake.sources.shared import kept, new_folder


def texts(n, seed=1):
    """Chunks over words of very different frequency, some empty or null."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 120])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "x^2 √ π"), (n + 3, "y " * 3000)]


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query string")


def top(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 7)) for r in df.collect())


def plain(queries, chunks, k):
    return top(R.bm25_topk(R.bm25_scores(queries, chunks), k))


QUERIES = [(1, "w1 w2 w7"), (2, "w1 w1 w3 w9 w30 w200"), (3, "none of these"), (4, "squared sqrt pi y"), (5, None), (6, "w450"), (7, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_keyword_index(spark, k, monkeypatch):
    monkeypatch.setattr(KI, "SLOT", 8)
    monkeypatch.setattr(KI, "FEW", k % 2 * 1000)  # by bounds and all at once
    chunks = spark.createDataFrame(texts(300), "chunk_id long, content string")
    KI.append(chunks, path := new_folder(spark))
    q = asked(spark, QUERIES)
    assert top(KI.topk(q, path, k)) == plain(q.where("query is not null"), chunks, k)


def test_scores_stay_where_they_are_made(spark, monkeypatch):
    """Parts of few slots, copies of a text, and slots left out by their bounds give the same hits; scores
    are not shuffled before all but a part's best are gone."""
    monkeypatch.setattr(KI, "SLOT", 4)
    monkeypatch.setattr(KI, "GROUP", 2)
    monkeypatch.setattr(KI, "FEW", 0)
    rows = texts(300, 3)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    KI.append(chunks, path := new_folder(spark))
    q = asked(spark, QUERIES)
    want = plain(q.where("query is not null"), chunks, 5)
    assert top(KI.topk(q, path, 5)) == want == top(KI.topk(q, path, 5, leave_out=True))
    plan = KI.scores(q, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(segment") == 1 and "hashpartitioning(query_id" not in plan
    terms = kept(KI._asked(q, path))
    postings, avg, tasks = KI._read(terms, path)
    assert tasks > 30 and KI._best(KI._scored(postings, terms, avg, tasks), terms, 1).count() < KI.scores(q, path).count() / 3


@pytest.mark.parametrize("slice_bytes, queries, cells, k", [(4_000_000, 1000, 1_000_000, 5), (300, 2, 7, 1), (50, 1, 1, 3), (1000, 1000, 40, 40)])
def test_keyword_scan(spark, slice_bytes, queries, cells, k, monkeypatch):
    """Equal to scoring by joins, however texts, questions and scores are cut, with equal texts and empty ones."""
    for name, n in (("SLICE", slice_bytes), ("WORDS", 50), ("QUERIES", queries), ("CELLS", cells), ("PAIRS", 30)):
        monkeypatch.setattr(KS, name, n)
    rows = texts(120) + [(1000 + i, "w1 w2 the same words w5") for i in range(30)] + [(2000, ""), (2001, None), (2002, "... !?")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)
    q = asked(spark, QUERIES)
    assert top(KS.topk(q, chunks, k)) == plain(q.where("query is not null"), chunks, k)
    every = lambda df: {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in df.collect()}
    assert every(KS.scores(q, chunks)) == every(R.bm25_scores(q.where("query is not null"), chunks))
    one, many = ({r["term"]: (r["df"], round(r["idf"], 9)) for r in m(chunks)[1].collect()} for m in (KS.stats, R.bm25_stats))
    assert one == many and KS.stats(chunks.limit(0))[0].first()["n"] == 0 == KS.topk(q, chunks.limit(0), k).count()
    few = KS.scores(asked(spark, [(1, "w1 w2 w5")]), chunks, k=1)
    assert 0 < few.count() < 20


def test_spaced_words_are_the_tokens(spark):
    """Every character is in a word or between words as ``tokens`` has it."""
    rows = spark.createDataFrame([(f"a{chr(i)}B",) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000], "t string")
    assert rows.where(N.spaced(F.col("t")) != F.array_join(N.tokens(F.col("t")), " ")).count() == 0


def test_scores_are_not_moved(spark):
    """Each score is made where its text is read: no word, count or score of a chunk goes through a shuffle."""
    for name in ("k4_bm25_scores", "k5_bm25_topk"):
        plan = q_search.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == (name == "k5_bm25_topk") and "MapInArrow" in plan


def test_embedding_as_a_column(spark):
    """The same vectors as a table and as a column, in slices of any size; nulls as empty texts."""
    rows = spark.createDataFrame(texts(40), "id long, text string")
    want = sorted(map(tuple, R.encode(rows).collect()))
    assert sorted(map(tuple, R.encoded(rows).select("id", "embedding").collect())) == want and len(want) == 44
    assert "ArrowEvalPython" not in R.encoded(rows).select("id")._jdf.queryExecution().executedPlan().toString()


def test_slots_are_left_out(spark, monkeypatch):
    """With many slots most are never scored, and those that are hold the first hits."""
    monkeypatch.setattr(KI, "SLOT", 4)
    chunks = spark.createDataFrame(texts(600, 2), "chunk_id long, content string")
    KI.append(chunks, path := new_folder(spark))
    terms = KI._asked(asked(spark, [(1, "w1 w60 w200 w333")]), path)
    slots = KI.slot_bounds(terms, path).count()
    rest = KI.top_slots(terms, path, 3)[1].count()
    assert rest < slots / 2


def test_append(spark, monkeypatch):
    """In parts as at once; a batch that comes again, or partly, adds what is new alone."""
    monkeypatch.setattr(KI, "SLOT", 16)
    rows = texts(200)
    every = spark.createDataFrame(rows, "chunk_id long, content string")
    KI.append(every, whole := new_folder(spark))
    parts = new_folder(spark)
    for lo, hi in ((0, 90), (0, 90), (60, 150), (150, 204)):
        KI.append(spark.createDataFrame(rows[lo:hi] + rows[lo : lo + 3], every.schema), parts)
    q = asked(spark, QUERIES)
    assert top(KI.topk(q, parts, 10)) == top(KI.topk(q, whole, 10))
    one, many = ({r["term"]: (r["df"], round(r["idf"], 9)) for r in KI.stats(spark, p)[1].collect()} for p in (whole, parts))
    plain_terms = {r["term"]: (r["df"], round(r["idf"], 9)) for r in R.bm25_stats(every)[1].collect()}
    assert one == many == plain_terms
    got = [KI.stats(spark, p)[0].first() for p in (whole, parts)] + [R.bm25_stats(every)[0].first()]
    assert len({(r["n"], round(r["avg_size"], 9), round(r["mean_idf"], 9)) for r in got}) == 1


def test_a_second_search_reads_no_texts(spark, tmp_path):
    spark.createDataFrame(texts(100), "chunk_id long, content string").write.parquet(f"{tmp_path}/texts")
    KI.append(spark.read.parquet(f"{tmp_path}/texts"), path := new_folder(spark))
    for q in ([(1, "w1 w2")], [(2, "w3")]):
        found = KI.topk(asked(spark, q), path, 5)
        assert not any(f"{tmp_path}/texts" in f for f in found.inputFiles()) and found.count()


def test_an_unfinished_append_is_not_seen(spark):
    chunks = spark.createDataFrame(texts(50), "chunk_id long, content string")
    KI.append(chunks, path := new_folder(spark))
    before = top(KI.topk(asked(spark, QUERIES), path, 5))
    orphan = spark.read.parquet(f"{path}/postings").drop("segment").withColumn("ids", F.transform("ids", lambda x: x + 1000))
    orphan.write.partitionBy("bucket").parquet(f"{path}/postings/segment=unfinished")
    assert top(KI.topk(asked(spark, QUERIES), path, 5)) == before


def test_empty_tables(spark):
    none = spark.createDataFrame([], "chunk_id long, content string")
    KI.append(none, path := new_folder(spark))
    assert KI.topk(asked(spark, QUERIES), path, 5).count() == 0
    KI.append(spark.createDataFrame(texts(20), "chunk_id long, content string"), path)
    assert KI.topk(asked(spark, QUERIES), path, 5).count() > 0
    assert KI.topk(asked(spark, []), path, 5).count() == 0


# --- vectors ------------------------------------------------------------------------------------
def vectors(spark, n, seed=4, dim=16, clusters=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 3) for _ in range(dim)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        base = rng.choice(centres) if clusters else [0.0] * dim
        rows.append((i, [b + rng.gauss(0, 1) for b in base], f"t{i % 3}" if i % 7 else None))
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, topic string"), rows


def best(queries, rows, k, within=False):
    """Rank by rank, ties by id."""
    out = []
    for q, v, t in queries:
        if v is not None and not (within and t is None):
            scored = sorted((-round(float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), 6), c) for c, w, u in rows if w is not None and (not within or u == t))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("within", [None, "topic"])
def test_vector_grid(spark, within, monkeypatch):
    """Many cells give what one list of all pairs does; ties, nulls and a group without chunks too."""
    monkeypatch.setattr(R, "CELL_CHUNKS", 13)
    monkeypatch.setattr(R, "CELL_QUERIES", 4)
    monkeypatch.setattr(R, "PRODUCT_ROWS", 3)
    chunks, rows = vectors(spark, 120)
    rows += [(1000 + i, rows[5][1], "t1") for i in range(40)] + [(2000, None, "t1")]
    chunks = spark.createDataFrame(rows, chunks.schema)
    asked = [(i, *r[1:]) for i, r in enumerate(rows[:30])] + [(77, None, "t1"), (78, rows[0][1], "none")]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>, topic string")
    for k in (1, 7, 300):
        assert top(R.vector_topk(queries, chunks, k, within=within)) == [(q, r, c, round(s, 7)) for q, r, c, s in best(asked, rows, k, within is not None)]
    assert R.vector_topk(queries, chunks.limit(0), 5).count() == 0 and R.vector_topk(queries.limit(0), chunks, 5).count() == 0


def recall(spark, queries, chunks, path, k):
    exact = {(r["query_id"], r["chunk_id"]) for r in R.vector_topk(queries, chunks, k).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in VI.topk(queries, path, k).collect()}
    return len(exact & near) / len(exact)


def test_vector_index_without_clusters(spark):
    """The hardest vectors: recall at 5, and the share of the bytes of all vectors that a query reads."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    chunks = e.selectExpr("vec_id as chunk_id", "embedding")
    queries = e.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    VI.build(chunks, path := new_folder(spark))
    assert recall(spark, queries, chunks, path, 5) >= 0.9
    n, dim, asked = chunks.count(), 64, queries.count()
    cells = spark.read.parquet(f"{path}/cells")
    sizes = spark.read.parquet(f"{path}/codes").groupBy("cell").agg(F.count("*").alias("n"))
    per_query = cells.first()["probes"] / cells.count()
    fetched = VI.candidates(queries, path, 5).count() / asked
    assert sizes.agg(F.sum("n")).first()[0] == n and fetched == VI.KEEP * 5
    assert (per_query * n * (dim + 4) + fetched * dim * 4) / (n * dim * 4) < 0.25


def test_vector_index_with_clusters(spark):
    """Where vectors have clusters a few cells suffice; a search reads the files of those alone."""
    chunks, rows = vectors(spark, 3000, clusters=40)
    queries = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:20])], "query_id long, embedding array<float>")
    VI.build(chunks, path := new_folder(spark))
    cells = spark.read.parquet(f"{path}/cells")
    assert 30 <= cells.count() <= 80 and cells.first()["probes"] <= cells.count() / 5
    assert recall(spark, queries, chunks, path, 5) >= 0.9


def test_vector_index_of_equal_and_few_vectors(spark, monkeypatch):
    """A cell that no centre can part is written and searched in parts."""
    monkeypatch.setattr(VI, "PART", 50)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300 + i, [float(i), -1.0, 0.5]) for i in range(30)] + [(400, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [1.0, -5.0, 0.0]), (3, None)], "query_id long, embedding array<float>")
    VI.build(chunks, path := new_folder(spark))
    got = top(VI.topk(queries, path, 4))
    assert [r[3] for r in got if r[0] == 2] == [r[3] for r in best([(2, [1.0, -5.0, 0.0], None)], [(*r, None) for r in rows], 4)]
    assert spark.read.parquet(f"{path}/codes").select("cell", "part").distinct().groupBy("cell").count().agg(F.max("count")).first()[0] > 2
    VI.build(chunks.limit(1), one := new_folder(spark))
    assert VI.topk(queries, one, 4).count() == 2
    VI.build(chunks.limit(0), none := new_folder(spark))
    assert VI.topk(queries, none, 4).count() == 0
