"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name; sql gives the same rows in DuckDB."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small file is one split, and what follows is heavy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cents(df: DataFrame, *columns: str) -> DataFrame:
    """Columns in hundredths, halves up with a margin over what sums in another order differ by: engines round halves their own ways."""
    return df.withColumns({c: F.floor(F.col(c) * 100 + 0.500001) / 100 for c in columns})


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])
