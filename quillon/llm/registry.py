"""The queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that hold one or more queries each.
MODULES = ("q_gumbel", "q_huffman", "q_lines", "q_packing", "q_quality", "q_revisits", "q_secrets", "q_sharding", "q_sigtree", "q_topk")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= importlib.import_module(f"quillon.llm.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"quillon.llm.{m}"), "SQL", {})
    return out
