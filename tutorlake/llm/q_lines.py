"""op4: repeated lines of all documents, with SQL that leaves out every word of every line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorlake.llm import lines
from tutorlake.llm.common import table


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


QUERIES = {"op4_lines": op4_lines}
ORACLE_SQL = {
    "op4_lines": """
WITH pieces AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
    SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM pieces
), firsts AS (
    SELECT line, min((doc_id, line_no)) AS place, string_split(line, ' ') AS w
    FROM lines WHERE trim(line, ' ') <> '' AND doc_id IS NOT NULL GROUP BY line
), variants AS (
    SELECT place, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, w FROM firsts WHERE len(w) >= 5
), cut AS (
    SELECT place, n, i, array_to_string(list_concat(w[1:i-1], w[i+1:n]), ' ') AS v FROM variants
), swapped AS (
    SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY n, i, v) AS low FROM cut) WHERE low < place
), joined AS (
    SELECT c.place AS longer, f.place AS shorter FROM cut c JOIN firsts f ON c.v = f.line WHERE len(f.w) >= 5 AND len(f.w) = c.n - 1
), near AS (
    SELECT place FROM swapped
    UNION SELECT longer FROM joined WHERE shorter < longer
    UNION SELECT shorter FROM joined WHERE longer < shorter
), gone AS (
    SELECT DISTINCT l.doc_id, l.line_no, (l.doc_id, l.line_no) = f.place AS is_near
    FROM lines l JOIN firsts f ON l.line = f.line
    WHERE (l.doc_id, l.line_no) <> f.place OR f.place IN (SELECT place FROM near)
), by_doc AS (
    SELECT doc_id, count(*) FILTER (NOT is_near) AS n_equal, count(*) FILTER (is_near) AS n_near,
           string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed
    FROM gone GROUP BY doc_id
)
SELECT p.doc_id, CAST(len(p.l) AS BIGINT) AS n_lines, coalesce(g.n_equal, 0) AS n_equal,
       coalesce(g.n_near, 0) AS n_near, coalesce(g.removed, '') AS removed
FROM pieces p LEFT JOIN by_doc g ON p.doc_id = g.doc_id
"""
}
