"""op6: secrets in every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.secrets import PATTERNS, Markov, default_model, listed, with_spans


def _number(kind: str) -> Column:
    return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")


def _base() -> list[Column]:
    return [F.col("doc_id"), *[_number(k).alias(f"n_{k}") for k in PATTERNS], F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256")]


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs, default_model(docs)).select(*_base(), listed(F.col("secret_spans")).alias("spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 says of patterns alone, which SQL can say too."""
    return with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), Markov((), (), 0.0)).select(*_base())


def _sql() -> str:
    """Matches, and their places by the lengths of what lies between them."""
    # There, flags hold for a group: ((?i)a|b)(?-i) is ((?i:a|b)).
    plain = {k: p.replace("((?i)", "((?i:").replace(")(?-i)", "))").replace("'", "''") for k, p in PATTERNS.items()}
    good = {"assign": f"length(regexp_extract(g, '{plain['assign']}', 2)) >= 12", "access": "length(g) >= 18", "hex": "length(g) >= 16"}
    kinds = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{kind}' AS kind, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS b FROM t" for i, (kind, p) in enumerate(plain.items()))
    kept = " OR ".join(f"(kind = '{kind}' AND {test})" for kind, test in good.items())
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents
), m AS (
  {kinds}
), s AS (
  SELECT doc_id, k, kind, m[i] AS g, list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS st
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)
), f AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in PATTERNS)},
         string_agg(kind || ':' || CAST(CAST(st AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(st + length(g) AS BIGINT) AS VARCHAR), ',' ORDER BY st, k) AS spans
  FROM s WHERE {kept} GROUP BY doc_id
)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in PATTERNS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN f ON t.doc_id = f.doc_id
"""


QUERIES = {"op6_secret_scan": op6_secret_scan, "secret_base_spans": secret_base_spans}
SQL = {"secret_base_spans": _sql()}
