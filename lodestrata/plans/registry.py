"""All queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import answers, files, logs, search, tables  # noqa: F401  they register their queries
from lodestrata.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_search"](spark, sf_dir)
