"""The durable store: records under (kind, record_id), evaluation summaries, and its upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DuplicateRecord(ValueError):
    """An id that the store holds already, or that comes twice."""


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_records(df: DataFrame, path: str, kind: str, key: str = "record_id") -> None:
    """SRC6: append records of one kind; an id already there, or twice in df, is refused before anything is written."""
    spark, home = df.sparkSession, f"{path}/kind={kind}"
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise DuplicateRecord(f"ids repeat in the new {kind} records")
    if exists(spark, home) and df.join(spark.read.parquet(home).select(key), key, "left_semi").limit(1).count():
        raise DuplicateRecord(f"{kind} ids are already stored")
    df.write.mode("append").parquet(home)


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{path}/kind={kind}")


def append_summary(df: DataFrame, path: str, key: str = "run_id") -> None:
    """SRC7: append a run's summary; a run_id that is there already, or twice in df, is refused."""
    spark = df.sparkSession
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise DuplicateRecord("a run comes twice")
    if exists(spark, path) and df.join(spark.read.parquet(path).select(key), key, "left_semi").limit(1).count():
        raise DuplicateRecord("the run is already stored")
    df.coalesce(1).write.mode("append").parquet(path)


def recent_summaries(df: DataFrame, n: int, created: str = "created_at", key: str = "run_id") -> DataFrame:
    """SRC7: the n newest."""
    return df.orderBy(F.col(created).desc(), F.col(key).desc()).limit(n)


def delete_owners(df: DataFrame, ids: DataFrame, column: str = "document_id") -> DataFrame:
    """JOI8: rows of all owners but those given; ids: one column."""
    return df.join(ids.toDF(column), column, "left_anti")


def reconcile(durable: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """JOI9: one row: counts of both sides, of ids missing from the index and stale in it, and the verdict."""
    a, b = durable.select(key).distinct(), indexed.select(key).distinct()
    both = a.withColumn("d", F.lit(1)).join(b.withColumn("i", F.lit(1)), key, "full_outer")
    n = both.agg(F.count("d").alias("durable_count"), F.count("i").alias("indexed_count"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("d").isNull()).alias("stale"))
    return n.withColumn("verdict", F.when((F.col("missing") == 0) & (F.col("stale") == 0), "equal").otherwise("rebuild"))


def difference(durable: DataFrame, indexed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """JOI9: ids to add to the index, ids to take out of it."""
    a, b = durable.select(key).distinct(), indexed.select(key).distinct()
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def get_by_ids(df: DataFrame, ids: list, key: str) -> DataFrame:
    """JOI10: the rows of the ids in the order asked, with `pos`; unknown ids are passed over. The list is the caller's, and small."""
    asked = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, {key} {dict(df.dtypes)[key]}")
    return df.join(F.broadcast(asked) if len(ids) <= 100_000 else asked, key).orderBy("pos")


def catalogue(docs: DataFrame, media: DataFrame, datasets: DataFrame, kind: str = "all") -> DataFrame:
    """SET5: id, kind, filename of all knowledge, or of one kind."""
    parts = [df.select(F.col(df.columns[0]).cast("string").alias("id"), F.lit(k).alias("kind"), F.col("filename")) for df, k in ((docs, "document"), (media, "video"), (datasets, "dataset"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out if kind == "all" else out.where(F.col("kind") == kind)


def results_match(claimed: DataFrame, truth: DataFrame) -> DataFrame:
    """SET6: one row: rows only claimed, rows only true, and whether both are none. Counts of equal rows matter."""
    extra = claimed.exceptAll(truth).agg(F.count("*").alias("only_claimed"))
    lost = truth.exceptAll(claimed).agg(F.count("*").alias("only_true"))
    return extra.crossJoin(lost).withColumn("matches", (F.col("only_claimed") == 0) & (F.col("only_true") == 0))


def check_chart_rows(df: DataFrame, label: str, value: str, most: int = 100) -> DataFrame:
    """JSN2: one row: whether a chart of these rows is sound, and counts of what is wrong."""
    fields = {f.name: f.dataType.typeName() for f in df.schema.fields}
    numeric = fields.get(value) in ("byte", "short", "integer", "long", "float", "double", "decimal")
    keys = label in fields and value in fields and label != value and len(set(df.columns)) == len(df.columns)
    number = F.col(value).cast("double") if numeric else F.lit(None).cast("double")
    finite = F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
    text = F.col(label).cast("string") if label in fields else F.lit(None).cast("string")
    bad = F.coalesce((F.trim(text) == "") | text.rlike(r"[<>]") | text.rlike(r"(?i)javascript\s*:"), F.lit(True))
    n = df.agg(F.count("*").alias("n_rows"), F.count_if(~finite).alias("bad_values"), F.count_if(bad).alias("bad_labels"))
    return n.withColumn("keys_valid", F.lit(keys)).withColumn("valid", F.lit(keys) & (F.col("n_rows") <= most) & (F.col("bad_values") == 0) & (F.col("bad_labels") == 0))


def valid_intents(intents: DataFrame, objects: DataFrame, now, asset_type: str) -> DataFrame:
    """FIL5: upload intents with `reason`, null if usable. objects: object_path, stored_bytes. expires_at is the signed expiry or
    the configured end, whichever is first (see expiry)."""
    joined = intents.join(objects.select("object_path", "stored_bytes"), "object_path", "left")
    reason = (
        F.when(F.col("asset_type") != asset_type, "WRONG_ASSET_TYPE").when(F.col("consumed_at").isNotNull(), "ALREADY_CONSUMED").when(F.col("expires_at") <= F.lit(now).cast("timestamp"), "EXPIRED")
        .when(F.col("stored_bytes").isNull(), "OBJECT_MISSING").when(F.col("stored_bytes") != F.col("size_bytes"), "SIZE_MISMATCH")
    )
    return joined.withColumn("reason", reason)


def expiry(signed, now, ttl_seconds: int):
    return F.least(signed, F.timestamp_seconds(F.unix_timestamp(now) + ttl_seconds))
