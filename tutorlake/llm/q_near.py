"""op7 and op12: classes of near-duplicate documents. The SQL counts shared shingles of all pairs and follows
links; tests compare with all pairs on small tables too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorlake.llm import jaccard, minhash
from tutorlake.llm.common import table


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard": op7_jaccard, "op12_minhash": op12_minhash}
_SQL = """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS node, a AS low FROM edges UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node),
    least AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id{more}
    FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON node = d.doc_id"""
ORACLE_SQL = {
    "op7_jaccard": _SQL.format(percent=80, more=""),
    "op12_minhash": _SQL.format(percent=85, more=", coalesce(low, d.doc_id) = d.doc_id AS kept"),
}
