"""op3: revisits of all pages.

``pages`` holds full responses only, so records are made from it.  Page i is a
response at time 2000 + 2i, its entity tag is the digest of its html and its
date is by i.  Two revisits are made for each page: one 1000 pages later with
its entity tag, which fails if the URL was captured anew meanwhile, and one
just before the capture with a date, which finds an earlier capture or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.revisits import resolve


def records(pages: DataFrame) -> DataFrame:
    i, tag = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    date = F.concat(F.lit("day "), F.floor(i / 100).cast("string"))
    made = F.array(
        F.struct((3 * i).alias("record_id"), (2000 + 2 * i).alias("ts"), F.lit(False).alias("revisit"), F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html")).alias("headers")),
        F.struct((3 * i + 1).alias("record_id"), (4001 + 2 * i).alias("ts"), F.lit(True).alias("revisit"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Date"), F.concat(F.lit("later "), date), F.lit("Content-Type"), F.lit("none")).alias("headers")),
        F.struct((3 * i + 2).alias("record_id"), (1999 + 2 * i).alias("ts"), F.lit(True).alias("revisit"), F.create_map(F.lit("last-modified"), date).alias("headers")),
    )
    return pages.select("url", F.explode(made).alias("r")).select("url", "r.*")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(records(table(spark, sf_dir, "pages")))
    return out.withColumn("headers", F.array_join(F.transform("headers", lambda e: F.concat(e["name"], F.lit("="), e["value"])), ";"))


QUERIES = {"op3_revisits": op3_revisits}
SQL = {
    "op3_revisits": r"""
WITH p AS (
  SELECT page_id AS i, md5(coalesce(html, '')) AS tag, 'day ' || CAST(page_id // 100 AS VARCHAR) AS day,
    regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[^=]*|ref|gclid|fbclid|sessionid)(=.*)?'))), '&') AS q
  FROM pages
), c AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS u FROM p
), v AS (
  SELECT 3 * i + 1 AS id, u, 4001 + 2 * i AS ts, tag, NULL AS day, 'content-type=none;date=later ' || day || ';etag=W/' || tag AS own,
         'date=later ' || day || ';etag=W/' || tag AS part FROM c
  UNION ALL SELECT 3 * i + 2, u, 1999 + 2 * i, NULL, day, 'last-modified=' || day, NULL FROM c
), f AS (
  SELECT 3 * i AS id, u, 2000 + 2 * i AS ts, tag, day FROM c
), j AS (
  SELECT v.*, f.id AS r, f.tag AS t, f.day AS d FROM v ASOF LEFT JOIN f ON v.u = f.u AND v.ts > f.ts
), s AS (
  SELECT *, CASE WHEN r IS NULL THEN 'no_earlier' WHEN tag IS NOT NULL THEN CASE WHEN tag = t THEN 'resolved' ELSE 'mismatch' END
                 WHEN day = d THEN 'resolved' ELSE 'mismatch' END AS status FROM j
)
SELECT id AS record_id, u AS canonical_url, ts, CASE WHEN status = 'resolved' THEN r END AS refers_to, status,
  CASE WHEN status <> 'resolved' THEN own
       WHEN tag IS NOT NULL THEN 'content-type=text/html;' || part || ';last-modified=' || d
       ELSE 'content-type=text/html;etag=' || t || ';last-modified=' || day END AS headers
FROM s
"""
}
