"""Sharding by best-fit-decreasing bin packing of indivisible groups (rows with equal texts).

The packer sorts items by size and puts each into the bin of tightest remaining capacity that holds it, found in a balanced
tree of (remaining capacity, bin); a new bin opens where none holds it, so the count of fixed-capacity bins stays small.

Groups are summed by Spark, and counted by size: packing depends on sizes only, so the packer on the driver holds one entry for each
size that occurs (sizes that differ are fewer than the root of twice all bytes) and places all groups of a size as runs. Each
group then finds its run by its rank among those of its size. For `shards` bins of near equal size, the capacity is
the least, to a millionth, with which the packing needs no more bins; an item that exceeds an equal share gets a bin of its own.
With a `capacity` instead, bins are as many as the packing opens, and a group over it has one of its own.

Defined results: a null text counts as no bytes, the empty text's; each row adds 1 byte, so empty texts have a size. Null
texts and empty texts are one group each; texts are told apart by 128-bit hashes. Rows with equal texts share a shard, equal rows included; slots number each
shard's rows without gaps, in an order fixed by doc_id and text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm._shared import staged, table

#: Runs that may be broadcast, 24 bytes each.
BROADCAST_RUNS = 500_000


class Tree:
    """A treap of keys: insert, remove and the least key not under a bound, each in logarithmic expected time."""

    def __init__(self):
        self.root, self.seed = None, 1

    def _draw(self) -> int:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return self.seed >> 33

    def insert(self, key) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self._draw(), None, None]), high)

    def remove(self, key) -> None:
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (*key[:-1], key[-1] + 1))
        self.root = self._merge(low, high)

    def ceiling(self, bound):
        node, best = self.root, None
        while node:
            if node[0] >= bound:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def _split(self, node, key):
        """Keys under `key`, and the others."""
        if not node:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low, high):
        if not low or not high:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._merge(low[3], high)]
        return [high[0], high[1], self._merge(low, high[2]), high[3]]


Runs = dict[int, list[tuple[int, int]]]


def pack(counts: dict[int, int], capacity: int, most: int | None = None) -> Runs | None:
    """Best-fit-decreasing of counts[size] items of each size: by size, runs of (bin, items); None if over `most` bins are needed.

    Equal items that follow each other fill the bin of the first of them as far as they go, since it stays the tightest that
    holds them. An item over the capacity gets a bin of its own.
    """
    bins, tree, out = 0, Tree(), {}
    for size in sorted(counts, reverse=True):
        left, runs = counts[size], []
        while left:
            found = tree.ceiling((size, -1))
            if found is None:
                if bins == most:
                    return None
                room, at = max(capacity, size), bins
                bins += 1
            else:
                room, at = found
                tree.remove(found)
            some = min(left, room // size)
            runs.append((at, some))
            left -= some
            if room > some * size:
                tree.insert((room - some * size, at))
        out[size] = runs
    return out


def pack_evenly(counts: dict[int, int], shards: int, fine: int = 1 << 20) -> Runs:
    """Bins 0 to shards - 1 by the least capacity, to a part in `fine`, with which best-fit-decreasing needs no more; oversized items apart."""
    rest, free, total, own = dict(counts), shards, sum(s * n for s, n in counts.items()), []
    while rest and free > 1 and (largest := max(rest)) * free >= total:
        free -= 1
        own.append((largest, free))
        total -= largest
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
    low = -(-total // free)
    high, best = low + max(rest, default=0), None
    while best is None or high - low > low // fine:
        middle = (low + high) // 2
        if (found := pack(rest, middle, free)) is not None:
            high, best = middle, found
        elif low >= high:  # the bound of first-fit packings holds for practical inputs; widen it where it does not
            low, high = high + 1, 2 * high + 1
        else:
            low = middle + 1
    for size, at in own:
        best[size] = [(at, 1), *best.get(size, [])]
    return best


def shard_documents(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, group, shard, slot. Without `shards` as many of `capacity` bytes as the packing takes."""
    raw = F.encode(F.col(text), "UTF-8")
    rank_key = F.sha2(F.concat(F.when(F.col(text).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(text), F.lit(""))), 256)
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"), F.substring(rank_key, 1, 32).alias("group"))
    slim = staged(slim, "sizes")
    groups = staged(slim.groupBy("group").agg(F.sum("size").alias("weight")), "groups")
    counts = {r["weight"]: r["count"] for r in groups.groupBy("weight").count().collect()}  # sizes that differ: under the root of twice all bytes
    runs = pack_evenly(counts, shards) if shards else pack(counts, capacity)
    ends = [(size, [(sum(n for _, n in own[: i + 1]), at) for i, (at, _) in enumerate(own)]) for size, own in runs.items()]
    placed = docs.sparkSession.createDataFrame(ends, "weight long, runs array<struct<until: long, shard: int>>")
    placed = F.broadcast(placed) if sum(len(own) for _, own in ends) <= BROADCAST_RUNS else placed
    ranked = numbered(groups, "weight", ("group",), "rank").join(placed, "weight")
    shard = F.get(F.filter("runs", lambda r: r["until"] > F.col("rank")), F.lit(0))["shard"]
    return with_slots(slim.join(ranked.select("group", shard.alias("shard")), "group"))


def numbered(df: DataFrame, by: str, order: tuple[str, ...], name: str) -> DataFrame:
    """df with gapless numbers from 0 within each value of `by`: each value's rows are dealt into parts by hash, numbered in them, and set off by their counts."""
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(by, "_part").count()
    before = counts.select(by, "_part", (F.sum("count").over(W.partitionBy(by).orderBy("_part")) - F.col("count")).alias("_before"))
    rows = dealt.withColumn("_row", F.row_number().over(W.partitionBy(by, "_part").orderBy(*order)))
    return rows.join(before, [by, "_part"]).withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_before")


def with_slots(placed: DataFrame) -> DataFrame:
    """Gapless numbers within each shard."""
    return numbered(placed, "shard", ("doc_id", "text_crc32", "group", "size"), "slot")


def op5_shard_packing(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
