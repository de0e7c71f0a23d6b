"""VEC2 for hashed texts: exact neighbours by whole counts of slots instead of vectors of doubles.

A text is the few slots that its tokens fall into. Queries are broadcast, a bounded number of bytes at a time, and lie as a table of slots by
queries in each task; a vector's products with all of them are sums of a few of its rows, of one byte a query where counts are small.
A product counts if it is as high as the query's k-th best so far needs at the vector's length, so few are looked at one by one. Nothing is
left out: products are whole numbers, and only pairs that cannot be among the first k are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.retrieval import Best, hashed_slots, rank_candidates
from lodestrata.sources.staging import in_rounds, staged

#: Cells of a table of slots by queries; texts that are put in order of length together, at first and later; pairs that are taken in at once.
CELLS, FIRST, CHUNK, PAIRS = 1 << 23, 64, 8192, 1 << 18
#: Counts up to this are added one by one.
FEW = 4


def count_slots(df: DataFrame, text_col: str, dim: int) -> DataFrame:
    """df with slots (two bytes each) and counts (four) of its texts instead of them."""
    slots_of = hashed_slots(dim)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [np.unique(slots_of(text), return_counts=True) for text in part[text_col].fillna("")]
            yield part.drop(columns=text_col).assign(slots=[s.astype("<u2").tobytes() for s, _ in found], counts=[c.astype("<u4").tobytes() for _, c in found])

    kept = df.drop(text_col)
    return df.mapInPandas(run, f"{kept._jdf.schema().toDDL()}, slots binary, counts binary")


class Texts:
    """Slots and counts of many texts."""

    def __init__(self, slots: list[bytes], counts: list[bytes]):
        sizes = np.array([len(x) // 2 for x in slots], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        self.slots, self.counts = np.frombuffer(b"".join(slots), "<u2").astype(np.int64), np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
        self.squares = np.bincount(self.rows, self.counts * self.counts.astype(float), len(sizes))
        self.sizes = np.sqrt(self.squares)

    def __len__(self) -> int:
        return len(self.squares)

    def part(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = slice(self.ends[a], self.ends[b])
        return self.rows[own] - a, self.slots[own], self.counts[own]


class Asked:
    """A block of queries as a table of slots by queries."""

    def __init__(self, texts: Texts, a: int, b: int, dim: int):
        self.first, self.sizes = a, texts.sizes[a:b]
        self.width = -(-(b - a) // 8) * 8
        rows, slots, counts = texts.part(a, b)
        self.tables: dict[type, np.ndarray] = {}
        self.most = np.zeros(dim)
        np.maximum.at(self.most, slots, counts)

        def table(kind: type) -> np.ndarray:
            if kind not in self.tables:
                self.tables[kind] = np.zeros((dim, self.width), kind)
                self.tables[kind][slots, rows] = counts
            return self.tables[kind]

        self.table = table

    def products(self, texts: Texts) -> Callable[[int], np.ndarray]:
        """The products of text i of texts with all queries; overwritten by the next call's."""
        bounds = np.bincount(texts.rows, self.most[texts.slots] * texts.counts, len(texts))
        most = np.zeros(len(texts), np.int64)
        np.maximum.at(most, texts.rows, texts.counts)
        expanded = np.concatenate([[0], np.cumsum(np.bincount(texts.rows, np.minimum(texts.counts, FEW), len(texts)).astype(np.int64))]).tolist()
        slots = np.repeat(texts.slots, np.minimum(texts.counts, FEW)).tolist()
        room = {kind: np.empty(self.width, kind) for kind in (np.uint8, np.uint16)}

        def run(i: int) -> np.ndarray:
            if most[i] > FEW or bounds[i] > 65535:
                own = slice(texts.ends[i], texts.ends[i + 1])
                return texts.counts[own].astype(float) @ self.table(np.float64)[texts.slots[own]]
            kind = np.uint8 if bounds[i] <= 255 else np.uint16
            table, out = self.table(kind), room[kind]
            own = slots[expanded[i] : expanded[i + 1]]
            if len(own) == 1:
                return table[own[0]]
            np.add(table[own[0]], table[own[1]], out)
            for slot in own[2:]:
                np.add(out, table[slot], out)
            return out

        return run


def meet(asked: Asked, best: Best, texts: Texts, names: np.ndarray, floor: float) -> None:
    """Take the products of all texts with a block of queries in."""
    n, products = len(asked.sizes), asked.products(texts)
    rows: list[np.ndarray] = []
    dots: list[np.ndarray] = []
    which: list[int] = []
    held = 0

    def take() -> None:
        nonlocal held
        if rows:
            own, at = np.concatenate(rows), np.repeat(which, [len(x) for x in rows])
            distances = np.round(np.maximum(0.0, 1 - np.concatenate(dots).astype(float) / (asked.sizes[own] * texts.sizes[at])), 12)
            best.take(own + asked.first, distances, names[at])
        for x in (rows, dots, which):
            x.clear()
        held = 0

    order = np.argsort(texts.squares, kind="stable")
    edges = np.flatnonzero(np.diff(texts.squares[order], prepend=-1, append=-1)).tolist()
    for a, b in zip(edges, edges[1:]):
        length = texts.sizes[order[a]]
        at, needs = -1, {}
        for i in order[a:b].tolist():
            if at != best.cuts:  # what the k-th best of each query needs at this length, with a margin over rounding
                at = best.cuts
                least = np.maximum(1 - best.least[asked.first : asked.first + n], floor)
                need = np.full(asked.width, np.inf)
                need[:n] = np.maximum(np.ceil((least - 1e-9) * asked.sizes * length - 1e-6), 0)
                needs = {np.dtype(kind): np.minimum(need, np.iinfo(kind).max).astype(kind) for kind in (np.uint8, np.uint16)} | {np.dtype(float): need}
            found = products(i)
            enough = found >= needs[found.dtype]
            eights = np.flatnonzero(enough.view(np.uint64))
            if len(eights):
                close = (eights[:, None] * 8 + np.arange(8)).ravel()
                close = close[enough[close]]
                rows.append(close)
                dots.append(found[close])
                which.append(i)
                held += len(close)
                if held >= PAIRS:
                    take()
    take()


def nearest(asked, k: int, dim: int, floor: float) -> Callable:
    """asked: a broadcast of (names, slots, counts) of queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, slots, counts = asked.value
        every, width = Texts(slots, counts), max(1, CELLS // dim)
        blocks = [Asked(every, i, min(i + width, len(every)), dim) for i in range(0, len(every), width)]
        best, size = Best(len(every), k), FIRST
        for part in batches:
            i = 0
            while i < len(part):
                own = part.iloc[i : i + size]
                texts = Texts(own["slots"].tolist(), own["counts"].tolist())
                for block in blocks:
                    meet(block, best, texts, own["at"].to_numpy(), floor)
                i += size
                if size < CHUNK:  # the k-th best of a few spare most of the next ones
                    best.cut()
                    size *= 2
        for rows, distances, ats in best.found(1 << 16):
            yield pd.DataFrame({"query_id": names[rows], "at": ats, "distance": distances})

    return run


def knn_hashed(queries: DataFrame, texts: DataFrame, k: int, floor: float = 0.0, dim: int = 256) -> DataFrame:
    """query_id, vector_id, distance, rank of the k texts (vector_id, text) nearest to each query (query_id, text) as hashed_embedder has them.

    What knn gives for their vectors, without pairs of a similarity under floor.
    """
    spark = queries.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    named = lambda df, key: df.select(F.col(key).cast("string").alias(key), "text")
    # texts are numbered in the order of their ids, which ties go by
    ordered = named(texts, "vector_id").repartitionByRange(tasks, "vector_id").sortWithinPartitions("vector_id")
    held = staged(count_slots(ordered.withColumn("at", F.monotonically_increasing_id()), "text", dim), "slots", 10_000)
    own = count_slots(named(queries, "query_id").repartition(tasks), "text", dim)
    asked, rounds = in_rounds(own, F.octet_length("slots") + F.octet_length("counts") + F.octet_length("query_id") + 100, "asked")
    kind = "query_id string, at long, distance double"
    found = spark.createDataFrame([], kind)
    for r in range(rounds):
        rows = asked.where(F.col("round") == r).drop("round").collect()  # of one round: bounded
        asked_now = spark.sparkContext.broadcast((np.array([x["query_id"] for x in rows], object), [bytes(x["slots"]) for x in rows], [bytes(x["counts"]) for x in rows]))
        found = found.unionByName(staged(held.select("at", "slots", "counts").mapInPandas(nearest(asked_now, k, dim, floor), kind), "nearest", 10_000))
        asked_now.destroy()
    ranked = rank_candidates(found, [F.col("distance"), F.col("at")], k)
    return ranked.join(held.select("at", "vector_id"), "at").select("query_id", "vector_id", "distance", "rank")
