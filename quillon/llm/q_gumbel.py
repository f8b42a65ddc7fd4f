"""op1: three distinct sampled segmentations of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.gumbel import sample_segmentations


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample_segmentations(table(spark, sf_dir, "documents"), 3)
    return out.withColumn("n_ids", (F.octet_length("ids") / 4).cast("long")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {"op1_gumbel_segmentations": op1_gumbel_segmentations}
