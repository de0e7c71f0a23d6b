"""Token-id files coded by an adaptive context-mixing range coder, in groups of checksummed blocks.

Up to LANES blocks of BLOCK ids are a group. They are coded in step, one id of each at a time, and learn from each other:

- order 2 and order 1 predict an id from what last followed the two ids, or the one id, before; each prediction has a class
  by how often it held lately. Which of them holds, if any, is coded with shares mixed from two contexts: both classes with
  the predictions' agreement, and the agreement alone. All of this begins anew in each group and adapts to every id coded, at the end of
  each RUN of steps. Within a run it stays as it is, so a run is modelled at once in writing.
- order 0 codes other ids by shares that are counted over the segment and stored before its blocks; an id too rare for
  a share of its own is coded as such and then evenly.

Shares have powers of two as totals; those of event and order 0 are multiplied, so an id is one stretch for a carry-free range coder on 64-bit
state that emits 16-bit words. Each step works on all blocks of the group by array operations, in coder and decoder alike.

A file holds rows (part, segment, doc_ids, counts, sizes, sums, payload): whole documents of up to about SEGMENT ids, with each block's
count of words and CRC-32, the shares with a CRC-32 of their own. Parts are ranges of doc_id, in order, and so are segments within a part; Spark writes them
as Parquet, and a lost executor's part is simply written again.

Defined results: a null or empty text is the end id alone. Documents go by doc_id (nulls first), those that share one by their
text's hash. A text's ids are never split over segments; ids must be under 2**20. A block whose sum differs raises `Damaged`. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm._shared import shared_folder, table
from lodestrata.llm.word_ids import word_ids

#: Ids of a block; blocks of a group, which has 2**23 ids at most; ids of a segment.
BLOCK, LANES, SEGMENT = 512, 16384, 8_000_000
#: Slots of a table of predictions, as a power of two at most; steps that are modelled at once, after which models adapt to them.
SLOTS, RUN = 14, 8
U, FULL = np.uint64, np.uint64(1 << 48)
#: Ids are under MOST. Totals of shares as powers of two: of events, of order 0, of ids that have no share.
MOST = 1 << 20
EVENT, ORDER0, RARE = 12, 16, 20


class Damaged(ValueError):
    """A block's ids do not match its checksum."""


class Shares:
    """Order 0: each listed id has a stretch of 2**ORDER0 slots, and all others have one together, the last."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        ids, sizes = ids.astype(np.int64), sizes.astype(np.int64)
        if len(ids) != len(sizes) or sizes.sum() >= 1 << ORDER0:
            raise Damaged("shares")
        ends = np.cumsum(sizes)
        self.ids, self.sizes = ids, sizes
        self.rest = int(ends[-1]) if len(ends) else 0
        # by place in the list, with all others as one more
        self.listed, self.starts, self.widths = np.append(ids, MOST), np.append(ends - sizes, self.rest), np.append(sizes, (1 << ORDER0) - self.rest)
        self.slots = np.repeat(np.arange(len(self.widths)), self.widths).astype(np.uint16)
        self.start, self.size = np.full(MOST, self.rest), np.zeros(MOST, np.int64)  # by id; size 0: not listed
        self.start[ids], self.size[ids] = ends - sizes, sizes

    @classmethod
    def of(cls, ids: np.ndarray) -> Shares:
        """A power under 1 of the counts: the more frequent an id, the more of it the other orders predict."""
        most = int(ids.max()) + 1
        counts = sum(np.bincount(ids[at : at + (1 << 18)], minlength=most) for at in range(0, len(ids), 1 << 18))
        seen = np.flatnonzero(counts)
        weight = counts[seen] ** 0.75
        ideal = weight * ((1 << ORDER0) / weight.sum())
        listed = ideal >= 2  # at most half of the slots go to ids by right, so all have one at least
        rest = max(1.0, ideal[~listed].sum())
        sizes = np.maximum(1, ideal[listed] * (1 - (rest + listed.sum()) / (1 << ORDER0)))
        return cls(seen[listed], sizes.astype(np.int64))

    def packed(self) -> bytes:
        body = zlib.compress(np.concatenate([np.diff(self.ids, prepend=0), self.sizes]).astype("<u4").tobytes(), 1)
        return np.array([len(body), zlib.crc32(body)], "<u4").tobytes() + body + b"\0" * (len(body) % 2)

    @classmethod
    def read(cls, payload: bytes) -> tuple[Shares, int]:
        """The shares before a payload's blocks, and how many bytes they take."""
        size, crc = (int(x) for x in np.frombuffer(payload[:8], "<u4")) if len(payload) >= 8 else (0, 1)
        body = payload[8 : 8 + size]
        if zlib.crc32(body) != crc:
            raise Damaged("shares")
        steps, sizes = np.frombuffer(zlib.decompress(body), "<u4").reshape(2, -1)
        return cls(np.cumsum(steps, dtype=np.int64), sizes), 8 + size + size % 2


class Models:
    """What the blocks of a group learn together: ids that follow one id and two, with a class by how often that held, and shares of events."""

    def __init__(self, count: int):
        slots = 1 << min(SLOTS, max(8, count.bit_length() - 4))
        self.mask = slots - 1
        self.tables = [np.zeros(slots, np.int64) for _ in range(2)]  # by one and two ids before: the predicted id << 6 | its class << 1, or << 3
        self.held = [np.zeros((2, slots), np.int64) for _ in range(2)]  # hits and tries of each, of late
        self.events = np.zeros((3, 32), np.int64)  # order 2 holds, order 1 does, or neither; by context
        self.events[2] = 1
        self._mix()

    def places(self, before: np.ndarray, older: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of both tables."""
        last = before * 40503
        return last >> 4 & self.mask, (last + older * 30011) >> 4 & self.mask

    def predict(self, at1: np.ndarray, at2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both predictions, and the context of their event: both classes, and whether they agree."""
        v1, v2 = self.tables[0].take(at1), self.tables[1].take(at2)
        p1, p2 = v1 >> 6, v2 >> 6
        return p1, p2, ((v1 | v2) & 30) | (p1 == p2)

    def learn(self, at1: np.ndarray, at2: np.ndarray, is1: np.ndarray, is2: np.ndarray, context: np.ndarray, ids: np.ndarray) -> None:
        """Adapt to a run of ids, given where and how they were predicted."""
        for table, held, shift, at, hit in zip(self.tables, self.held, (1, 3), (at1.ravel(), at2.ravel()), (is1.ravel(), is2.ravel()), strict=True):
            tries = np.bincount(at, minlength=len(table))
            held += (np.bincount(at[hit], minlength=len(table)), tries)
            hits, of = held
            table &= ~np.int64(63)
            table |= ((hits * 8 >= of * 3).astype(np.int64) + (hits * 4 >= of * 3) + 1) * (of > 0) << shift
            # under 1 of 8 right: the id that came last takes the place
            wrong = np.flatnonzero((hits * 8 < of) & (tries > 0))
            latest = np.zeros(len(table), np.int64)
            np.maximum.at(latest, at, np.arange(len(at)))
            table[wrong] = ids.ravel()[latest[wrong]] << 6
            held[:, wrong] = 0
            held >>= 1
        which = is2.view(np.int8) + (is1 | is2)
        self.events += np.bincount((context + (which.astype(np.int64) << 5)).ravel(), minlength=96).reshape(3, 32)[::-1]
        self._mix()

    def _mix(self) -> None:
        """Shares of events by context: its own counts with 32 more, spread as in all contexts that agree, or in all that do not."""
        plain = np.tile(np.stack([self.events[:, agree::2].sum(axis=1) for agree in (0, 1)], axis=1), 16)
        of = plain.sum(axis=0)
        # each event keeps 1 of 4096 at least; whole numbers under 2**60, as a group has 2**23 ids
        first, second = ((self.events * of + 32 * plain) * ((1 << EVENT) - 3) // ((self.events.sum(axis=0) + 32) * of))[:2] + 1
        self.end0, self.end1 = first << ORDER0, (first + second) << ORDER0
        self.left = (1 << EVENT) - first - second


class Lanes:
    """The coder states of many blocks in step."""

    def __init__(self, n: int, words: np.ndarray | None = None, at: np.ndarray | None = None):
        """Of n blocks; in decoding with all words, and where each block's begin."""
        self.low, self.range, self.code = np.zeros(n, U), np.full(n, ~U(0)), np.zeros(n, U)
        self.words = words
        if words is None:
            self.out = np.zeros((6 * BLOCK + 8, n), "<u2")  # lanes side by side: they grow alike; an id takes at most 5 words: 2 to where it is cut short, 3 from a range of 1
            self.length = np.zeros(n, np.int64)
        else:
            for k in range(4):
                self.code = (self.code << U(16)) | words.take(at + k, mode="clip").astype(U)
            self.at = at + 4

    def settle(self, m: int) -> None:
        """Emit, or read, words until every state has room for one more id."""
        low, rng = self.low[:m], self.range[:m]
        go = np.flatnonzero(rng < FULL)  # not where the top words are the same: that also holds at 2**48, which shifted would be 0
        while len(go):
            a, r = low.take(go), rng.take(go)
            apart = np.flatnonzero((a + (r - U(1))) ^ a >= FULL)
            r[apart] = FULL - (a[apart] & (FULL - U(1)))
            if self.words is None:
                at = self.length.take(go)
                self.out.reshape(-1)[at * self.out.shape[1] + go] = a >> U(48)
                at += 1
                self.length[go] = at
            else:
                at = self.at.take(go)
                self.code[go] = (self.code.take(go) << U(16)) | self.words.take(at, mode="clip")
                at += 1
                self.at[go] = at
            a <<= U(16)
            r <<= U(16)
            low[go] = a
            rng[go] = r
            go = go.take(np.flatnonzero(r < FULL))

    def encode(self, starts: np.ndarray, sizes: np.ndarray, rare: np.ndarray | None) -> None:
        """One id of each of the first lanes, by its stretch of 2**(EVENT + ORDER0); rare, if there are any, holds ids + 1, or 0 where it is not one."""
        m = len(starts)
        low, rng = self.low[:m], self.range[:m]
        rng >>= U(EVENT + ORDER0)
        low += rng * starts
        rng *= sizes
        if rare is not None:
            who = np.flatnonzero(rare)
            unit = rng[who] >> U(RARE)
            low[who] += unit * (rare[who] - 1).astype(U)
            rng[who] = unit
        self.settle(m)

    def decode(self, m: int, shares: Shares, models: Models, p1: np.ndarray, p2: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The next id of each of the first m lanes."""
        low, rng = self.low[:m], self.range[:m]
        rng >>= U(EVENT + ORDER0)
        found = ((self.code[:m] - low) // rng).view(np.int64)
        end0, end1, left = models.end0.take(context), models.end1.take(context), models.left.take(context)
        is2, new = found < end0, found >= end1
        found -= end1
        which = shares.slots.take((found.view(U) // left.view(U)).view(np.int64), mode="clip")  # of no use where an order holds
        ids = np.where(new, shares.listed.take(which), np.where(is2, p2, p1))
        starts = np.where(new, end1 + left * shares.starts.take(which), np.where(is2, 0, end0))
        sizes = np.where(new, left * shares.widths.take(which), np.where(is2, end0, end1 - end0))
        low += rng * starts.view(U)
        rng *= sizes.view(U)
        rare = ids == MOST
        if rare.any():
            rare = np.flatnonzero(rare)
            unit = rng[rare] >> U(RARE)
            value = np.minimum((self.code[rare] - low[rare]) // unit, U(MOST - 1))
            ids[rare] = value
            low[rare] += unit * value
            rng[rare] = unit
        self.settle(m)
        return ids


def runs(n: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Steps of a group of n blocks with size ids in all: first and end step, and the count of blocks in them."""
    last = size - (n - 1) * BLOCK
    end = BLOCK if n > 1 else last
    edges = sorted({e for e in (1, 2, 4, *range(0, end, RUN), last, end) if e <= end})
    for a, b in zip(edges, edges[1:]):
        yield a, b, n if b <= last else n - 1


def encode_ids(ids: np.ndarray) -> tuple[list[int], list[int], bytes]:
    """Words per block, CRC-32 per block, and the shares of order 0 and all words as bytes."""
    sizes, sums, payload = [], [], []
    blocks = -(-len(ids) // BLOCK)
    if blocks:
        shares = Shares.of(ids)
        payload.append(shares.packed())
    for first in range(0, blocks, LANES):
        own = ids[first * BLOCK : (first + LANES) * BLOCK].astype("<u4")
        n = -(-len(own) // BLOCK)
        grid = np.zeros((n, BLOCK), "<u4")
        grid.ravel()[: len(own)] = own
        lanes, models = Lanes(n), Models(len(own))
        columns = np.zeros((RUN + 2, n), np.int64)  # the two before, and a run
        for a, b, m in runs(n, len(own)):
            now = columns[2 : b - a + 2, :m]
            now[:] = grid[:m, a:b].T
            at1, at2 = models.places(columns[1 : b - a + 1, :m], columns[: b - a, :m])
            p1, p2, context = models.predict(at1, at2)
            is1, is2 = now == p1, now == p2
            end0, end1, left = models.end0.take(context), models.end1.take(context), models.left.take(context)
            size = shares.size.take(now)
            rare = size == 0
            rare &= ~(is1 | is2)
            some = rare.any()
            if some:
                size[rare] = (1 << ORDER0) - shares.rest
            starts = np.where(is2, 0, np.where(is1, end0, end1 + left * shares.start.take(now))).view(U)
            widths = np.where(is2, end0, np.where(is1, end1 - end0, left * size)).view(U)
            for t in range(b - a):
                lanes.encode(starts[t], widths[t], np.where(rare[t], now[t] + 1, 0) if some else None)
            models.learn(at1, at2, is1, is2, context, now)
            columns[:2] = columns[b - a : b - a + 2]
        for k in (48, 32, 16, 0):  # the state's own words
            lanes.out[lanes.length, np.arange(n)] = lanes.low >> U(k) & U(0xFFFF)
            lanes.length += 1
        emitted = np.ascontiguousarray(lanes.out[: lanes.length.max()].T)
        sizes += lanes.length.tolist()
        payload += [words[:size].tobytes() for words, size in zip(emitted, lanes.length.tolist(), strict=True)]
        sums += [zlib.crc32(x) for x in grid[:-1]]
        sums.append(zlib.crc32(own[(n - 1) * BLOCK :].tobytes()))
    return sizes, sums, b"".join(payload)


def decode_ids(count: int, sizes: np.ndarray, sums: np.ndarray, payload: bytes) -> np.ndarray:
    out = np.zeros(count, np.int64)
    if not count:
        return out
    if len(sizes) != -(-count // BLOCK):
        raise Damaged("blocks")
    shares, skip = Shares.read(payload)
    words = np.frombuffer(payload, "<u2", offset=skip)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for first in range(0, len(sizes), LANES):
        n = min(LANES, len(sizes) - first)
        size = min(count - first * BLOCK, n * BLOCK)
        lanes, models = Lanes(n, words, starts[first : first + n]), Models(size)
        columns, grid = np.zeros((RUN + 2, n), np.int64), np.zeros((n, BLOCK), "<u4")
        for a, b, m in runs(n, size):
            kept = []
            for t in range(b - a):
                at1, at2 = models.places(columns[t + 1, :m], columns[t, :m])
                p1, p2, context = models.predict(at1, at2)
                columns[t + 2, :m] = ids = lanes.decode(m, shares, models, p1, p2, context)
                kept.append((at1, at2, ids == p1, ids == p2, context))
            grid[:m, a:b] = columns[2 : b - a + 2, :m].T
            models.learn(*map(np.array, zip(*kept, strict=True)), columns[2 : b - a + 2, :m])
            columns[:2] = columns[b - a : b - a + 2]
        own = grid.ravel()[:size]
        for i in range(n):
            if zlib.crc32(own[i * BLOCK : (i + 1) * BLOCK]) != sums[first + i]:
                raise Damaged(f"block {first + i}")
        out[first * BLOCK : first * BLOCK + size] = own
    return out


FILE = "part int, segment int, doc_ids array<bigint>, counts array<bigint>, sizes array<int>, sums array<bigint>, payload binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode all documents in ascending doc_id order into files under folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, segment = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        names: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            if int(ids.max()) >= MOST:
                raise ValueError(f"ids must be under {MOST}")
            sizes, sums, payload = encode_ids(ids)
            values = [(part, pa.int32()), (segment, pa.int32()), (names, pa.list_(pa.int64())), (counts, pa.list_(pa.int64())), (sizes, pa.list_(pa.int32())), (sums, pa.list_(pa.int64())), (payload, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["part", "segment", "doc_ids", "counts", "sizes", "sums", "payload"])

        for batch in batches:
            of, at = batch.column(0).to_pylist(), 0
            for ids, found in own.encode(batch.column(1)):
                ids = np.insert(ids, np.cumsum(found), end_id)
                ends = np.concatenate([[0], np.cumsum(found + 1)])  # of documents in this run
                first = 0
                while first < len(found):
                    stop = min(len(found), int(np.searchsorted(ends, ends[first] + SEGMENT - size)))
                    names += of[at + first : at + stop]
                    counts += np.diff(ends[first : stop + 1]).tolist()
                    held.append(ids[ends[first] : ends[stop]])
                    size += len(held[-1])
                    first = stop
                    if size >= SEGMENT:
                        yield row()
                        names, counts, held, size, segment = [], [], [], 0, segment + 1
                at += len(found)
        if names:
            yield row()

    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, FILE).write.parquet(folder)


def read_token_files(spark, folder: str, ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    files = spark.read.schema(FILE).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.array(r["counts"], np.int64)
                raw = decode_ids(int(counts.sum()), np.array(r["sizes"]), np.array(r["sums"]), r["payload"]).astype("<u4")
                stop = np.cumsum(counts)
                sums = [zlib.crc32(raw[e - c : e].tobytes()) for e, c in zip(stop, counts, strict=True)]
                columns = [pa.array(np.full(len(counts), r["part"], np.int32)), pa.array(np.full(len(counts), r["segment"], np.int32)), pa.array(r["doc_ids"], pa.int64()), pa.array(stop - counts), pa.array(counts), pa.array(sums, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(raw.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "doc_id", "own_start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = files.mapInArrow(run, "part int, segment int, doc_id long, own_start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    # offsets: of parts, of which there are few, and of segments within each part
    sizes = files.select("part", "segment", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    segments = sizes.withColumn("within", F.sum("size").over(W.partitionBy("part").orderBy("segment")) - F.col("size"))
    by_part = sizes.groupBy("part").agg(F.sum("size").alias("part_size"))
    parts = by_part.select("part", (F.sum("part_size").over(W.orderBy("part")) - F.col("part_size")).alias("part_start"))
    placed = rows.join(F.broadcast(segments.join(parts, "part").select("part", "segment", (F.col("within") + F.col("part_start")).alias("segment_start"))), ["part", "segment"])
    return placed.select("doc_id", (F.col("segment_start") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(spark, folder)
