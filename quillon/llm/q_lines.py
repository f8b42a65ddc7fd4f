"""op2: which lines of each document go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.lines import dedup_lines


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"),
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


#: All pairs of lines that share a word rare enough to be in both prefixes of a
#: count order; then the Jaccard similarity of whole sets.
SQL_LINES = """
WITH l AS (
  SELECT doc_id, n_lines, u.i - 1 AS i, u.x AS x,
         list_sort(list_distinct(list_filter(string_split_regex(lower(u.x), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))) AS w
  FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines,
               unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), string_split(text, chr(10)))) AS z
        FROM documents WHERE text IS NOT NULL), LATERAL (SELECT z[1] AS i, z[2] AS x) u
), e AS (
  SELECT doc_id, i, w, len(w) AS n, row_number() OVER (ORDER BY doc_id, i) AS plc FROM l WHERE len(w) >= 1
), s AS (
  SELECT min(plc) AS plc, w, any_value(n) AS n FROM e GROUP BY w
), t AS (
  SELECT plc, n, unnest(w) AS t FROM s
), f AS (
  SELECT t, count(*) AS c FROM t GROUP BY t
), o AS (
  SELECT plc, n, t.t, row_number() OVER (PARTITION BY plc ORDER BY c, t.t) AS r FROM t JOIN f ON t.t = f.t
), p AS (
  SELECT * FROM o WHERE r <= n - CAST(ceil(n * 17 / 20) AS BIGINT) + 1
), c AS (
  SELECT DISTINCT a.plc AS a, b.plc AS b FROM p a JOIN p b ON a.t = b.t AND b.plc < a.plc AND a.n * 17 <= b.n * 20 AND b.n * 17 <= a.n * 20
), g AS (
  SELECT DISTINCT c.a FROM c JOIN s x ON c.a = x.plc JOIN s y ON c.b = y.plc
  WHERE len(list_intersect(x.w, y.w)) * 20 >= 17 * (x.n + y.n - len(list_intersect(x.w, y.w)))
), k AS (
  SELECT plc FROM s WHERE plc NOT IN (SELECT a FROM g)
), r AS (
  SELECT doc_id, i FROM e WHERE plc NOT IN (SELECT plc FROM k)
), m AS (
  SELECT l.doc_id, string_agg(CASE WHEN r.i IS NULL THEN l.x END, chr(10) ORDER BY l.i) AS kept,
         count(r.i) AS n_removed, coalesce(string_agg(CAST(r.i AS VARCHAR), ',' ORDER BY r.i), '') AS removed, count(*) AS n_lines
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed,
       coalesce(m.removed, '') AS removed, md5(coalesce(m.kept, '')) AS kept_md5
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {"op2_line_dedup": SQL_LINES}
