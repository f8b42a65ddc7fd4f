"""op10: all documents through token files and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.huffman import roundtrip


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {"op10_token_files": op10_token_files}
