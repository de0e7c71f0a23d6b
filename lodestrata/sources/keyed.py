"""STM6: a store of records by key that takes in batches, each record once, without reading itself.

Keys lie in buckets by hash; every batch writes its records, its keys by bucket, and a membership filter of them: bitmaps of the places to
which several hashes of a key send it. A new batch looks its keys up in the filters first. Only keys that these may know are
compared with stored keys, and only in their buckets. A batch counts once its filter is complete, which is written last; one that broke
off before is written anew under the same id, and one that counts is not taken in again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.staging import staged
from lodestrata.sources.store import exists

BUCKETS, HASHES = 64, 4
#: Bits of the filter; at about 10 bits a key one new key in 80 is compared for nothing.
BITS = 1 << 33


class KeyedStore:
    """Records under a folder that all executors share. key: a column of theirs, not null."""

    def __init__(self, spark: SparkSession, path: str, key: str = "record_id", buckets: int = BUCKETS, bits: int = BITS):
        self.spark, self.path, self.key, self.buckets, self.bits = spark, path, key, buckets, bits

    def batches(self) -> list[str]:
        """The batches that count."""
        home = f"{self.path}/filters"
        if not exists(self.spark, home):
            return []
        at = self.spark._jvm.org.apache.hadoop.fs.Path(home)
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)
        names = sorted(s.getPath().getName().removeprefix("batch=") for s in found)
        return [n for n in names if exists(self.spark, f"{home}/batch={n}/_SUCCESS")]

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.path}/{part}").parquet(*paths).drop("batch")

    def records(self) -> DataFrame | None:
        paths = [f"{self.path}/records/batch={b}" for b in self.batches()]
        return self.spark.read.parquet(*paths) if paths else None

    def _places(self) -> Column:
        """The bits of a key, counted from 1 as the bitmap functions do."""
        return F.array(*[F.pmod(F.xxhash64(F.col(self.key), F.lit(i)), F.lit(self.bits)) + 1 for i in range(HASHES)])

    def maybe_known(self, new: DataFrame) -> DataFrame:
        """The keys of new, with their buckets, that the filters do not rule out."""
        slot, place = F.bitmap_bucket_number("place"), F.bitmap_bit_position("place")
        bits = self._read("filters", "slot bigint, bits binary").groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits"))
        asked = new.select(self.key, "_bucket", F.explode(self._places()).alias("place")).select(self.key, "_bucket", slot.alias("slot"), place.alias("at"))
        byte = "cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
        there = F.coalesce(F.expr(f"shiftright({byte}, cast(at % 8 as int)) & 1 = 1"), F.lit(False))
        known = asked.join(bits, "slot", "left").withColumn("set", there)
        return known.groupBy(self.key, "_bucket").agg(F.bool_and("set").alias("all")).where("all").drop("all")

    def add(self, batch: str, df: DataFrame) -> int:
        """Take in the records of df whose keys are new; how many stored keys were read for it. Of equal keys in df one record is kept."""
        if batch in self.batches():
            return 0
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = staged(df.dropDuplicates([self.key]).withColumn("_bucket", bucket), "arrived")
        read = 0
        if self.batches():
            maybe = staged(self.maybe_known(new), "maybe-known")
            buckets = [r[0] for r in maybe.select("_bucket").distinct().collect()]  # at most as many as there are buckets
            if buckets:
                stored = self._read("keys", f"`{self.key}` {dict(df.dtypes)[self.key]}, _bucket int").where(F.col("_bucket").isin(buckets))
                known = maybe.join(stored, [self.key, "_bucket"], "left_semi")
                read = stored.count()
                new = new.join(known.select(self.key), self.key, "left_anti")
        new = staged(new, "added")
        new.drop("_bucket").write.mode("overwrite").parquet(f"{self.path}/records/batch={batch}")
        new.select(self.key, "_bucket").repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/keys/batch={batch}")
        places = new.select(F.explode(self._places()).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("slot"))
        places.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch}")
        return read
