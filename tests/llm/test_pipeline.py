"""The five stages on a small table, each judged on what it was given."""

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.test_joins import brute_classes, brute_lines


def test_stages(docs, odd_rows, spark, tmp_path):
    from tests.llm.test_texts import _many

    rows = [(k, t + f" id{k}\nshared line of the text here {k % 3}") for k, t, *_ in _many(90)]
    leak = "der die und item words that leak into one document of the table here"
    rows = [(k, t, "en") for k, t in rows] + [(500, rows[0][1] + " x", "en"), (501, "el que los " + leak, "es"), (502, "12 34", None)] + [(k and k + 1000, t, "en") for k, t in odd_rows if k != 2]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [given]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(f"{tmp_path}/out{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/out{i}"))
    pairs = [sorted(((r["doc_id"], r["text"]) for r in t.collect()), key=str) for t in tables[:-1]]
    assert pairs[1] == [p for p in pairs[0] if p[1] and any(c.isalpha() for c in p[1])]
    gone = brute_lines(pairs[1])
    want = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)) for k, t in pairs[1]]
    assert pairs[2] == sorted([p for p in want if p[1].strip()], key=str)
    assert pairs[3] == [p for p, (_, c) in zip(pairs[2], brute_classes(pairs[2])) if c == p[0] or p[0] is None]
    assert pairs[4] == [p for p in pairs[3] if leak not in p[1]]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(((r["doc_id"], r["ids"]) for r in tables[5].collect()), key=str) == sorted(((k, lib.encode(t, add_special_tokens=False).ids) for k, t in pairs[4]), key=str)
    assert all(t.columns == given.columns for t in tables[:-1])
    assert corpus_pipeline.run(spark, sf).count() == tables[5].count()


def test_no_language_no_count_of_characters_no_rows(docs, spark, tmp_path):
    """Without labelled languages none is rejected; null texts and those without words go later."""
    rows = [(k, t, None) for k, t in [(1, "one line of the text"), (2, None), (3, ""), (4, "another line of it"), (5, "12 34")]]
    for name, table in (("none", docs(rows)), ("empty", docs([]))):
        table.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(7, "nothing that leaks")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/none").collect()) == [1, 4, 5]
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_hand_small_batches_to_python(docs, spark, tmp_path):
    """After a stage, Arrow batches of the session are bounded in bytes, whatever the texts."""
    given = docs([(k, "word " * 100_000, None) for k in range(40)]).coalesce(1)
    kept = corpus_pipeline.STAGES[0][1](spark, given, str(tmp_path))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    found = [r["n"] for r in kept.select("text").mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 15_000_000 and max(found) < 5_200_000


def test_language_classifies_small_slices(monkeypatch):
    import pyarrow as pa

    from tutorlake.llm import langid

    seen = []
    monkeypatch.setattr(langid, "_classify", lambda model, texts: (seen.append(sum(map(len, texts))), ["en"] * len(texts), [0.5] * len(texts))[1:])
    got = langid.sliced({})(pa.array(["x" * 100_000] * 9 + [None], pa.string()))
    assert len(got) == 10 and max(seen) <= 250_000
