"""Packing by concatenate and cut: documents' ids, end to end, cut into sequences of a fixed length.

Two passes over token totals give every document its place:

1. Each task encodes its documents and writes their ids as segments of up to SEGMENT ids, each with the count of ids that
   the task wrote before it. The segments are a table in the shared folder: what follows reads it, so a task that
   is run again cannot move what others have placed.
2. The tasks' totals, one row each, are summed up in order. A segment's global offset is its part's sum plus its own count, and
   sequence borders are the multiples of the length: every segment is cut on its own, wherever it lies. A piece is the
   part of one document in one sequence.

Only the last sequence of all is not full: the padding is under one sequence however many tasks there are. A sequence that begins in
one segment and ends in the next is a boundary record in both; `sequences` joins those, and only those, by their number.

Defined results: a null or empty text is the end id alone; equal rows are documents each; ids repeat freely, null ids stay null; no
documents give no pieces. A document may be cut anywhere; besides sequence borders one of over SEGMENT ids is cut where a segment
ends, so it may have two pieces in one sequence there. Other columns are not read. Ids must be under 2**32.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm._shared import shared_folder, small_batches, table
from lodestrata.llm.word_ids import word_ids

LENGTH, SEGMENT = 4096, 1 << 20
#: Parts (tasks of the first pass) whose offsets may be broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_PARTS = 1_000_000
#: Parts summed up by one task.
SUMMED = 1024

# a segment: documents in order, each with the ids before this stretch, its count here and in all; wide: 4 bytes an id, not 2
STORE = "part int, before long, total long, doc_ids array<bigint>, starts array<bigint>, counts array<bigint>, doc_tokens array<bigint>, wide boolean, payload binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Segment:
    """Stretches of documents until there are enough for a row."""

    def __init__(self, part: int, before: int, most: int):
        self.part, self.before, self.most = part, before, most
        self.stretches: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        self.stretches.append((doc_id, start, len(ids), doc_tokens))
        self.ids.append(ids)
        self.size += len(ids)

    def row(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        wide = bool(ids.max(initial=0) >= 1 << 16)
        lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in zip(*self.stretches, strict=True)]
        first = [pa.array([self.part], pa.int32()), pa.array([self.before], pa.int64()), pa.array([self.size], pa.int64())]
        last = [pa.array([wide]), pa.array([ids.astype("<u4" if wide else "<u2").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*first, *lists, *last], names=[c.split()[0] for c in STORE.split(", ")])


def write_segments(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text", segment: int = SEGMENT
) -> None:
    """First pass: all documents' ids, the end id behind each, as segments under folder, in the order in which tasks read them."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path)
        held = Segment(TaskContext.get().partitionId(), 0, segment)
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for run, counts in encoder.encode(batch.column(1)):
                ends = np.cumsum(counts)
                run = np.insert(run, ends, end_id)
                for name, count, end in zip(names[at:], (counts + 1).tolist(), (ends + np.arange(1, len(ends) + 1)).tolist()):
                    start = 0
                    while start < count:
                        some = min(count - start, segment - held.size)
                        held.add(name, start, run[end - count + start : end - count + start + some], count)
                        start += some
                        if held.size == segment:
                            yield held.row()
                            held = Segment(held.part, held.before + held.size, segment)
                at += len(counts)
        if held.size:
            yield held.row()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession, 2000):
        slim.mapInArrow(encode, STORE).write.parquet(folder)


def with_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Second pass: the segments with `at`, the count of all ids before them."""
    segments = spark.read.schema(STORE).parquet(folder)
    sums = segments.groupBy("part").agg(F.sum("total").alias("total")).withColumn("tens", F.floor(F.col("part") / SUMMED))
    before = lambda w, c: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(c)
    groups = sums.groupBy("tens").agg(F.sum("total").alias("size"))  # a row for SUMMED parts: few enough for one task
    groups = groups.select("tens", before(W.orderBy("tens"), "size").alias("group_at"))
    within = sums.withColumn("own", before(W.partitionBy("tens").orderBy("part"), "total"))
    parts = within.join(groups, "tens").select("part", (F.col("group_at") + F.col("own")).alias("part_at"))
    if sums.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)  # then the ids stay where they are
    return segments.join(parts, "part").withColumn("at", F.col("part_at") + F.col("before")).drop("part_at")


def cut(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment's ids, and of each piece in it the stretch it belongs to and its edges, counted from the segment's begin."""
    ids = np.frombuffer(row["payload"], "<u4" if row["wide"] else "<u2").astype("<u4")
    ends = np.cumsum(row["counts"])
    borders = np.arange(-row["at"] % length, len(ids), length)
    edges = np.unique(np.concatenate([[0], ends, borders]))
    return ids, np.searchsorted(ends, edges[:-1], side="right"), edges


def pieces(spark: SparkSession, folder: str, length: int = LENGTH) -> DataFrame:
    """A row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, of, edges = cut(row, length)
                raw = memoryview(ids.tobytes())
                sizes = np.diff(edges)
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                begins = np.cumsum(row["counts"]) - np.array(row["counts"], np.int64)
                starts = np.array(row["starts"], np.int64)[of] + edges[:-1] - begins[of]
                placed = edges[:-1] + row["at"]
                names = pa.array(row["doc_ids"], pa.int64()).take(pa.array(of))
                of_doc = np.array(row["doc_tokens"], np.int64)[of]
                rest = [pa.array(x, pa.int64()) for x in (starts, sizes, sums, of_doc, placed // length, placed % length)]
                yield pa.RecordBatch.from_arrays([names, *rest], names=[c.split()[0] for c in PIECE.split(", ")])

    with small_batches(spark, 4):
        return with_offsets(spark, folder).mapInArrow(run, PIECE)


def sequences(spark: SparkSession, folder: str, length: int = LENGTH, pad_id: int | None = None) -> DataFrame:
    """A row per sequence: sequence_id, n_tokens (without padding), ids. With pad_id the last one is filled up, unless its size is a power of two.

    Sequences that lie in one segment are given as they are; the ends of segments are boundary records and meet by sequence.
    """

    def run(inner: bool):
        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids = cut(row, length)[0].astype(np.int64)
                    edges = np.unique(np.concatenate([[0], np.arange(-row["at"] % length, len(ids), length), [len(ids)]]))
                    spans = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if (b - a == length) == inner]
                    for at in range(0, len(spans), 64):
                        own = spans[at : at + 64]
                        placed = np.array([a for a, _ in own], np.int64) + row["at"]
                        columns = [placed // length, placed % length, [ids[a:b] for a, b in own]]
                        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
                        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["sequence_id", "offset", "ids"])

        return windows

    kind = "sequence_id long, offset long, ids array<bigint>"
    with small_batches(spark, 4):
        placed = with_offsets(spark, folder)
        whole, ends = placed.mapInArrow(run(True), kind), placed.mapInArrow(run(False), kind)
    joined = ends.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    out = whole.select("sequence_id", "ids").unionByName(joined).select("sequence_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    if pad_id is None:
        return out
    n = F.col("n_tokens")
    room = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(length) - n).cast("int")
    return out.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), room)))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write the segments of docs and return their folder, for `pieces` and `sequences` of any length."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/packed-{uuid.uuid4().hex}"
    write_segments(docs, tokenizer_path, folder, end_id, doc_id, text)
    return folder


def op11_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pieces(spark, pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2))
