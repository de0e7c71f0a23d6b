"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a table that one broadcast may hold; a larger one is broadcast in rounds.
ROUND_BYTES = 16 << 20
#: What this process has staged, until `remove_staged`.
STAGED: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in spark.checkpoint.dir; where that is unset and all run in one process, in a folder set for it."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        home = spark.sparkContext.getCheckpointDir()
    return f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of few rows for what is planned and run inside: rows may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str, batch: int = 1000) -> DataFrame:
    """df written and read again: cuts the lineage and keeps work from being done twice."""
    path = new_path(df.sparkSession, name)
    STAGED.append(path)
    with small_batches(df.sparkSession, batch):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_rounds(blocks: DataFrame, size: Column, name: str, limit: int | None = None) -> tuple[DataFrame, int]:
    """blocks, staged, with the `round` in which each is broadcast, and how many rounds there are.

    size: a block's bytes. A round holds ROUND_BYTES, and its last block beyond. The rounds are numbered by one task from a row of two
    numbers for each block.
    """
    limit = limit or ROUND_BYTES
    held = staged(blocks.withColumn("_at", F.monotonically_increasing_id()), name, 64)
    ends = held.select("_at", F.sum(size.cast("long")).over(W.orderBy("_at").rowsBetween(W.unboundedPreceding, 0)).alias("_end"))
    filled = ends.select("_at", F.floor((F.col("_end") - 1) / limit).alias("_full"))
    rounds = filled.select("_at", (F.dense_rank().over(W.orderBy("_full")) - 1).alias("round"))  # large blocks leave no numbers out
    last = rounds.agg(F.max("round")).first()[0]
    if not last:
        return held.drop("_at").withColumn("round", F.lit(0)), 0 if last is None else 1
    return staged(held.join(rounds, "_at").drop("_at"), name, 64), last + 1


def remove_staged(spark: SparkSession) -> int:
    """Delete the tables that this process has staged, once nothing is read from them any more; how many there were."""
    paths = STAGED[:]
    STAGED.clear()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
