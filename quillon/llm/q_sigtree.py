"""op8: classes of near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.sigtree import near_classes


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op8_ngram_join": op8_ngram_join}
SQL = {
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '', ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))) END AS s FROM w
), u AS (
  SELECT doc_id, unnest(s) AS g FROM s
), n AS (
  SELECT doc_id, len(s) AS n FROM s
), r AS (
  SELECT g FROM u GROUP BY g HAVING count(*) > 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM (SELECT u.* FROM u JOIN r ON u.g = r.g) a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), t AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, t.c FROM t JOIN e ON t.doc_id = e.a
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(t.c) AS component_id FROM n JOIN t ON n.doc_id = t.doc_id GROUP BY ALL
"""
}
