"""op9: the quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.quality import GRID, RULES, Risk, quality_rules

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
RISK = Risk()


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), RISK).select(*COLUMNS)


#: A risk that few labels suffice for, so that cutoffs are found in small tables.
WIDE = Risk(alpha=0.45, delta=0.5)


def quality_rules_wide_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WIDE).select(*COLUMNS)


def _sql(risk: Risk) -> str:
    """The same in DuckDB, by unnested windows and the binomial sum by lgamma."""
    rules = ", ".join(f"('{r}')" for r in RULES)
    grid = ", ".join(f"({c})" for c in GRID)
    score = "CASE r.rule " + " ".join(f"WHEN '{r}' THEN 1000 * {a} > c.cutoff * greatest({b}, 1)" for r, (a, b) in RULES.items()) + " END"
    p = risk.alpha / len(RULES)
    return f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM d
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM g, (VALUES (0), (1), (2)) v(j) WHERE c > 1 GROUP BY doc_id
), f AS (
  SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), l AS (
  SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), k AS (
  SELECT lang, r.rule, c.cutoff, sum(CAST(({score}) AND good = 1 AS BIGINT)) AS k,
         sum(CAST(({score}) AND good = 0 AS BIGINT)) AS caught, sum(good) AS n
  FROM b JOIN l ON b.doc_id = l.doc_id, (VALUES {rules}) r(rule), (VALUES {grid}) c(cutoff)
  WHERE NOT base_failed GROUP BY ALL
), a AS (
  SELECT *, list_sum(list_transform(range(CAST(k AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
         + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) AS tail
  FROM k WHERE caught > k AND n > 0
), s AS (
  SELECT lang, rule, arg_max(cutoff, (caught - k) * 10000 + cutoff) AS cutoff FROM a
  WHERE tail <= {risk.delta!r} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM k)) * {len(RULES)}) GROUP BY lang, rule
), x AS (
  SELECT b.doc_id, bool_or({score.replace("r.rule", "s.rule").replace("c.cutoff", "s.cutoff")}) AS hit
  FROM b JOIN s ON b.lang IS NOT DISTINCT FROM s.lang GROUP BY b.doc_id
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(x.hit, false) AS kept
FROM b LEFT JOIN x ON b.doc_id = x.doc_id
"""


QUERIES = {"op9_quality_rules": op9_quality_rules, "quality_rules_wide_risk": quality_rules_wide_risk}
SQL = {"op9_quality_rules": _sql(RISK), "quality_rules_wide_risk": _sql(WIDE)}
