"""The corpus pipeline: quality rules, line dedup, near-duplicate documents,
secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver or
``run`` writes it as Parquet and reads it again as the next stage's docs.  All
stages but the last return the columns of ``documents``; the last returns the
pieces of sequences.  ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import key, table, written
from quillon.llm.lines import dedup_lines
from quillon.llm.packing import pack_documents
from quillon.llm.quality import quality_rules
from quillon.llm.secrets import default_model, redacted, with_spans
from quillon.llm.sigtree import near_classes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality_rules(_apart(docs), table(spark, sf_dir, "labels"), carry=True)
    return _back(judged.where("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like earlier lines go, and documents of which no word is left by that."""
    # Of counts alone: a filter on the new text would have it made once more.
    out = dedup_lines(_apart(docs).withColumn("__had", F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
    return _counted(_back(out.where(~F.col("__had") | (F.col("n_left") > 0)), docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row stays: of those with the least id and one text, the
    row that sorts first.  Rows are told apart by a 64-bit digest of id and text,
    so an id may be null or repeated.  Rows without a word are in no class."""
    rows = docs.withColumn("__row", F.xxhash64(key("doc_id"), "text"))
    classes = near_classes(rows.select("__row", "text"), id_col="__row").where("n_shingles > 0")
    named = classes.groupBy(key("doc_id").alias("__row")).agg(F.min(key("component_id")).alias("__class"), F.count(F.lit(1)).alias("__copies"))
    ids = rows.groupBy("__row").agg(F.min(key("doc_id")).alias("__id"))
    found = written(named.join(ids, "__row"), "classes")
    stay = found.groupBy("__class").agg(F.min(F.struct("__id", "__row")).alias("s")).select("s.__row")
    gone = written(found.select("__row").join(stay, "__row", "left_anti"), "gone")
    left = rows.join(gone, "__row", "left_anti")
    copied = found.where("__copies > 1").select("__row").join(gone, "__row", "left_anti")
    if copied.isEmpty():
        return left.select(*docs.columns)
    one = left.join(copied, "__row", "left_semi").groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("s")).select("s.*")
    return left.join(copied, "__row", "left_anti").select(*docs.columns).unionByName(one)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced by a mark."""
    found = with_spans(_apart(docs), default_model(docs))
    return _counted(_back(found.withColumn("text", redacted(F.col("text"), F.col("secret_spans"))), docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids and a digest of them."""
    return pack_documents(docs).withColumn("ids_crc32", F.crc32("ids"))


#: A character of a word.
WORD = r"[^\x20\x09-\x0D]"
#: Columns that operators use; others step aside while one adds its own.
USED = ("doc_id", "text", "lang")


def _apart(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c not in USED})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return out.select(*[F.col(c if c in USED else f"__own_{c}").alias(c) for c in docs.columns])


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]

#: Differencing and the search over labelled cutoffs are no SQL; the stages are
#: tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
