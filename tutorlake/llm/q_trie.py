"""op11: the prefix trie of rebuilt conversations. The SQL lists every prefix and sums subtrees by
joining prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorlake.llm import trie
from tutorlake.llm.common import table


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), family=20)


QUERIES = {"op11_trie": op11_trie}
ORACLE_SQL = {
    "op11_trie": r"""
    WITH t AS (
        SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, digest) AS turns FROM t GROUP BY conv_id),
    h AS (
        SELECT conv_id, turns, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h FROM own),
    r AS (
        SELECT h.conv_id, coalesce(b.turns[1:h], []) || h.turns[h + 1:] AS turns FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
    p AS (SELECT conv_id, len(turns) AS n, d, list_transform(turns[1:d], lambda x: x.d) AS path, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS words
        FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
    nodes AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
            sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
        FROM p GROUP BY path, d),
    kids AS (SELECT x.path, count(y.path) AS n_children FROM nodes x LEFT JOIN nodes y ON y.depth = x.depth + 1 AND y.path[1:x.depth] = x.path GROUP BY x.path),
    under AS (
        SELECT x.path, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((y.n_convs - 1) * y.words) AS saved_tokens
        FROM nodes x JOIN nodes y ON y.depth >= x.depth AND y.path[1:x.depth] = x.path JOIN kids k ON k.path = y.path GROUP BY x.path)
    SELECT x.conv_id, x.depth, a.conv_id AS parent_conv_id, x.n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
    FROM nodes x JOIN kids USING (path) JOIN under USING (path) LEFT JOIN nodes a ON a.depth = x.depth - 1 AND x.depth > 0 AND x.path[1:x.depth - 1] = a.path"""
}
