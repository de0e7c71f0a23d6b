"""Hard negatives by bounds along spanning trees of anchors.

An anchor's positives are its best rows of the same label; for each, the negatives are the best rows of other labels whose score lies
between `share` of the positive's score and that score. Scores are inner products of whole numbers, exact.

Anchors of like signs are packed into blocks, each with a least spanning tree over its anchors. Vectors are packed into chunks. Blocks are
broadcast, a bounded number of bytes at a time, so that chunks stay where they are: the table is read once for each such round of
anchors and never shuffled. In a task a chunk is scored at the tree's root; an anchor's score of a candidate then lies within its parent's
score, or range of scores, plus or minus the edge's length times the candidate's norm (and within the product of both norms). Only
candidates whose range meets what the anchor still needs are scored again:

1. positives: scores that reach the k-th best that the task has found;
2. negatives: scores in a window of one of the anchor's positives, from the k-th best that the task has found in it on.

Tasks hand on k rows for each anchor, or each window, which Spark ranks.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; vectors
meet only those of their own length; rows that share the anchor's id are its own and no positives or negatives; an anchor that stands
in several rows is asked once, with its least (vector, label); other repeated rows count each; equal scores go by id; a positive of a
score under 0 has no negatives, as no score is both at least its share and at most itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm._shared import small_batches, staged, table
from lodestrata.llm.topk_search import exact
from lodestrata.sources.staging import in_rounds

CHUNK, BLOCK = 2048, 512
#: Bytes of anchors that are broadcast at a time.
BROADCAST_BYTES = 64 << 20
SIGNS = 12
PACKET = "dim int, n int, ids binary, labels binary, values binary"


def usable(vectors: DataFrame, to_grid: Callable[[Column], Column], vec_id: str, embedding: str, label: str) -> DataFrame:
    """id, label, vector (whole numbers as doubles) of the rows that take part."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    there = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(embedding) > 0)
    grid = F.transform(embedding, lambda x: to_grid(x.cast("double")).cast("double"))
    return vectors.where(there & finite).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), grid.alias("vector"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """id, label, vector rows as packets of up to `size` vectors of one length, as they come."""

    def packet(dim: int, own: list[tuple]) -> pd.DataFrame:
        ids, labels, values = zip(*own, strict=True)
        raw = [np.array(x, np.int64).tobytes() for x in (ids, labels)]
        return pd.DataFrame({"dim": [dim], "n": [len(ids)], "ids": raw[:1], "labels": raw[1:], "values": [np.stack(values).tobytes()]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for part in parts:
            for row in zip(part["id"], part["label"], part["vector"], strict=True):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) == size:
                    yield packet(len(row[2]), held.pop(len(row[2])))
        for dim in list(held):
            yield packet(dim, held.pop(dim))

    return rows.select("id", "label", "vector").mapInPandas(run, PACKET)


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, its parent, the length of the edge) in an order in which parents come first; the root, of parent -1, is the row nearest to the mean."""
    start = int(np.argmin(np.linalg.norm(points - points.mean(0), axis=1)))
    near = np.linalg.norm(points - points[start], axis=1)
    parent, out = np.full(len(points), start), [(start, -1, 0.0)]
    near[start] = np.inf
    for _ in range(len(points) - 1):
        node = int(np.argmin(near))
        edge = float(near[node])
        out.append((node, int(parent[node]), edge))
        parent_distance = np.linalg.norm(points - points[node], axis=1)
        closer = (parent_distance < near) & np.isfinite(near)
        near[closer], parent[closer] = parent_distance[closer], node
        near[node] = np.inf
    return out


def walk(anchors: np.ndarray, tree: list, rows: np.ndarray, wanted: Callable[[int], tuple[float, float]], able: Callable[[int], np.ndarray], found: Callable) -> int:
    """Score rows at each anchor of the tree as far as their ranges meet what is wanted; how many scores that took.

    wanted gives an anchor's least and greatest score of use, able which rows it may have, and found takes (anchor, places, scores).
    """
    with np.errstate(over="ignore"):
        norms, own = np.linalg.norm(rows, axis=1), np.linalg.norm(anchors, axis=1)
    product = lambda x, y: np.nan_to_num(x * y, nan=np.inf, posinf=np.inf)  # noqa: E731  norms beyond doubles bound nothing
    low, high = np.empty((len(anchors), len(rows))), np.empty((len(anchors), len(rows)))
    scored = 0
    for node, parent, edge in tree:
        most = product(own[node], norms)
        if parent < 0:
            low[node], high[node] = -most, most
            at = np.arange(len(rows))
        else:
            reach = product(edge, norms)
            low[node], high[node] = np.maximum(low[parent] - reach, -most), np.minimum(high[parent] + reach, most)
            least, greatest = wanted(node)
            slack = 1e-9 * most + 1e-6  # rounding never drops a candidate
            at = np.flatnonzero(able(node) & (high[node] + slack >= least) & (low[node] - slack <= greatest))
        scored += len(at)
        if not len(at):
            continue
        scores = exact(anchors[node : node + 1], rows if len(at) == len(rows) else rows[at])[0]
        low[node, at] = high[node, at] = scores
        if parent < 0:
            least, greatest = wanted(node)
            keep = able(node) & (scores >= least) & (scores <= greatest)
        else:
            keep = (scores >= least) & (scores <= greatest)
        found(node, at[keep], scores[keep])
    return scored


class Best:
    """The k best (score, then smaller id) of each key."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def least(self, key) -> float:
        """What a score must reach to be among them."""
        scores = self.held[key][0] if key in self.held else ()
        return float(scores[-1]) if len(scores) == self.k else -np.inf

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            some = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[some], ids[some]
        if key in self.held:
            scores, ids = np.concatenate([self.held[key][0], scores]), np.concatenate([self.held[key][1], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.held[key] = scores[order], ids[order]


def read(row) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(ids, labels, vectors) of a pair's block of anchors and of its chunk."""
    sides = (row.a_ids, row.a_labels, row.a_values), (row.ids, row.labels, row.values)
    return tuple((np.frombuffer(i, np.int64), np.frombuffer(x, np.int64), np.frombuffer(v).reshape(-1, row.dim)) for i, x, v in sides)


def tree_of(row) -> list[tuple[int, int, float]]:
    nodes, parents = np.frombuffer(row.nodes, np.int32), np.frombuffer(row.parents, np.int32)
    return list(zip(nodes.tolist(), parents.tolist(), np.frombuffer(row.edges).tolist(), strict=True))


def find_positives(k: int) -> Callable:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, trees = Best(k), {}
        for part in parts:
            for row in part.itertuples():
                (names, labels, anchors), (ids, kinds, rows) = read(row)
                key = lambda i, n=names, b=row.block: (b, int(n[i]))
                if row.block not in trees:
                    trees[row.block] = tree_of(row)
                walk(
                    anchors, trees[row.block], rows,
                    wanted=lambda i: (best.least(key(i)), np.inf),
                    able=lambda i: (kinds == labels[i]) & (ids != names[i]),
                    found=lambda i, at, scores: best.add(key(i), scores, ids[at]),
                )
        for (block, anchor), (scores, ids) in best.held.items():
            yield pd.DataFrame({"block": block, "anchor_id": anchor, "positive_id": ids, "positive_score": scores})

    return run


def find_negatives(k: int, share: tuple[int, int]) -> Callable:
    def windows_of(row) -> dict[int, list[tuple]]:
        """Of each anchor: (its positive's rank, id and score, the least score of a negative)."""
        out: dict[int, list[tuple]] = {}
        if row.windows is not None:
            for w in row.windows:
                score = int(w["positive_score"])
                out.setdefault(int(w["anchor_id"]), []).append((int(w["place"]), int(w["positive_id"]), score, -(-share[0] * score // share[1])))
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, trees, windows = Best(k), {}, {}
        for part in parts:
            for row in part.itertuples():
                (names, labels, anchors), (ids, kinds, rows) = read(row)
                if row.block not in trees:
                    trees[row.block], windows[row.block] = tree_of(row), windows_of(row)
                own = lambda i, n=names, w=windows[row.block]: [((int(n[i]), *x[:3]), x[3]) for x in w.get(int(n[i]), ()) if x[3] <= x[2]]

                def wanted(i: int) -> tuple[float, float]:
                    each = own(i)
                    return min((max(float(low), best.least(key)) for key, low in each), default=np.inf), max((float(key[3]) for key, _ in each), default=-np.inf)

                def found(i: int, at: np.ndarray, scores: np.ndarray) -> None:
                    for key, low in own(i):
                        some = (scores >= low) & (scores <= key[3])
                        if some.any():
                            best.add(key, scores[some], ids[at[some]])

                walk(anchors, trees[row.block], rows, wanted, lambda i: (kinds != labels[i]) & (ids != names[i]), found)
        for (anchor, place, positive, score), (scores, ids) in best.held.items():
            yield pd.DataFrame({"anchor_id": anchor, "place": place, "positive_id": positive, "positive_score": score, "negative_id": ids, "negative_score": scores})

    return run


def in_blocks(anchors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of anchors of like signs with their trees and the round in which each is broadcast, and how many rounds there are."""

    def planted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                nodes, parents, edges = zip(*spanning_tree(np.frombuffer(row["values"]).reshape(-1, row["dim"])), strict=True)
                own = {"nodes": np.array(nodes, np.int32).tobytes(), "parents": np.array(parents, np.int32).tobytes(), "edges": np.array(edges).tobytes()}
                yield pd.DataFrame([{f"a_{c}": row[c] for c in ("ids", "labels", "values")} | {"dim": row["dim"]} | own])

    signs = F.transform(F.slice("vector", 1, SIGNS), lambda x: x >= 0)
    spark = anchors.sparkSession
    with small_batches(spark, 64):
        once = anchors.groupBy("id").agg(F.min(F.struct("vector", "label")).alias("own")).select("id", "own.*")
        sorted_ = once.repartitionByRange(signs, "id").sortWithinPartitions(signs, "id")
        packets = packed(sorted_, size).mapInPandas(planted, "a_ids binary, a_labels binary, a_values binary, dim int, nodes binary, parents binary, edges binary")
        return in_rounds(packets.withColumn("block", F.monotonically_increasing_id()), F.octet_length("a_values"), "anchor-blocks", BROADCAST_BYTES)


def against(chunks: DataFrame, blocks: DataFrame, rounds: int, search: Callable, kind: str, name: str) -> DataFrame:
    """search over all pairs of chunks and blocks, one round of blocks after the other."""
    out = chunks.sparkSession.createDataFrame([], kind)
    for r in range(rounds):
        pairs = chunks.join(F.broadcast(blocks.where(F.col("round") == r)), "dim")
        with small_batches(chunks.sparkSession, 8):
            out = out.unionByName(staged(pairs.mapInPandas(search, kind), name))
    return out


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
    to_grid: Callable[[Column], Column] = F.floor, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. to_grid makes components whole numbers."""
    spark = vectors.sparkSession
    rows = usable(vectors, to_grid, vec_id, embedding, label)
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)  # a small file is one split, and what follows is heavy
    with small_batches(spark):
        chunks = staged(packed(rows, chunk), "chunks")
    blocks, rounds = in_blocks(usable(anchors, to_grid, vec_id, embedding, label), block)
    first = against(chunks, blocks, rounds, find_positives(positives), "block long, anchor_id long, positive_id long, positive_score long", "positives")
    place = F.row_number().over(W.partitionBy("block", "anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = first.withColumn("place", place).where(F.col("place") <= positives)
    # a block's anchors have `positives` windows each at most
    windows = best.groupBy("block").agg(F.collect_list(F.struct("anchor_id", "place", "positive_id", "positive_score")).alias("windows"))
    ready = staged(blocks.join(windows, "block"), "anchor-windows")
    found = against(chunks, ready, rounds, find_negatives(negatives, share), "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long", "negatives")
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(vectors, vectors.where(F.col("vec_id") % 100 == 0), to_grid=lambda x: F.floor(256 * x))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
