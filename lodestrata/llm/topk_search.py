"""Exact top-k search by inner product, in three phases under one uniform threshold.

Vectors are packed into chunks, queries into blocks. Blocks are broadcast, a bounded number of bytes at a time, and each chunk meets each
block in the task that holds the chunk: the table is read once in each phase and round, and never copied for blocks of queries.

1. Gather: a task ranks its candidates by their score over the leading components, takes the exact scores of the k best
   and hands in, for each query, the k highest of those. The k-th highest of all scores handed in is a safe cutoff: at
   least k candidates reach it.
2. Collect: with the cutoffs joined to the query blocks, each pair keeps the candidates whose leading score plus the largest
   possible rest (the product of the norms of the remaining components) reaches the cutoff. No other can be among the k.
3. Resolve: the kept candidates' scores are computed in full; those that reach the cutoff are ranked per query, each task
   sending on k at most.

Products are exact: in float64 while the largest possible sum is under 2**53, with Python's integers beyond (then cut to
64 bits). Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
without id; vectors meet only vectors of their own length; rows that share the query's id are its own and no candidates;
repeated queries are asked once; equal scores rank by id; fewer than k candidates are all returned. Other columns are unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm._shared import small_batches, staged, table
from lodestrata.sources.staging import in_rounds

BLOCK = 2048
#: Bytes of queries that are broadcast at a time.
BROADCAST_BYTES = 64 << 20
NONE = np.iinfo(np.int64).min + 1  # of which the negative is also a number


def packed(vectors: DataFrame, key: str, rows: int = BLOCK) -> DataFrame:
    """(id, vector array<double>) rows as blocks of one vector length: dim, `key`, ids, values (both binary, float64 rows)."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, own = zip(*held.pop(dim), strict=True)
            ids = np.array(ids, np.int64)
            return pd.DataFrame({"dim": [dim], key: [int(ids.min())], "ids": [ids.tobytes()], "values": [np.stack(own).tobytes()]})

        for part in parts:
            for i, v in zip(part["id"], part["vector"], strict=True):
                own = np.asarray(v, np.float64)
                held.setdefault(len(own), []).append((i, own))
                if len(held[len(own)]) == rows:
                    yield block(len(own))
        for dim in list(held):
            yield block(dim)

    return vectors.select("id", "vector").mapInPandas(pack, f"dim int, {key} long, ids binary, values binary")


def usable(vectors: DataFrame, vec_id: str, embedding: str, to_grid: Callable[[Column], Column]) -> DataFrame:
    ok = F.size(embedding) > 0
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ok & finite).select(F.col(vec_id).cast("long").alias("id"), F.transform(embedding, lambda x: to_grid(x.cast("double"))).alias("vector"))


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued vectors as int64."""
    if safe(queries, rows):
        return (queries @ rows.T).astype(np.int64)
    return cut_to_64(whole(queries) @ whole(rows).T)


def exact_pairs(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same for row i of one with row i of the other."""
    if safe(queries, rows):
        return np.einsum("id,id->i", queries, rows).astype(np.int64)
    return cut_to_64((whole(queries) * whole(rows)).sum(1))


def safe(queries: np.ndarray, rows: np.ndarray) -> bool:
    return float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1] < 2**53


def whole(m: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)


def cut_to_64(m: np.ndarray) -> np.ndarray:
    return np.clip(m, int(NONE) + 1, np.iinfo(np.int64).max).astype(np.int64)


def read_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q = np.frombuffer(row.q_values).reshape(-1, row.dim)
    return np.frombuffer(row.q_ids, np.int64), q, np.frombuffer(row.ids, np.int64), np.frombuffer(row.values).reshape(-1, row.dim)


def merged(scores: np.ndarray, ids: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of each row, of these and those held before."""
    if more is not None:
        scores, ids = np.hstack([more[0], scores]), np.hstack([more[1], ids])
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def gather(k: int, lead: int) -> Callable:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple] = {}
        for part in parts:
            for row in part.itertuples():
                q_ids, q, ids, v = read_block(row)
                some = min(len(ids), 4 * k)
                part_scores = q[:, :lead] @ v[:, :lead].T
                part_scores[q_ids[:, None] == ids[None, :]] = -np.inf
                best = np.argpartition(-part_scores, some - 1, axis=1)[:, :some]
                scores = exact_pairs(np.repeat(q, some, axis=0), v[best.ravel()]).reshape(best.shape)
                near = ids[best]
                scores[near == q_ids[:, None]] = NONE
                at = (row.dim, row.block)
                held[at] = (q_ids, *merged(scores, near, held[at][1:] if at in held else None, k))
        for (dim, block), (q_ids, scores, near) in held.items():
            real = scores > NONE
            yield pd.DataFrame({"dim": dim, "block": block, "query_id": np.repeat(q_ids, real.sum(1)), "score": scores[real]})

    return run


def collect(k: int, lead: int) -> Callable:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple] = {}
        for part in parts:
            for row in part.itertuples():
                q_ids, q, ids, v = read_block(row)
                cut = dict(zip(row.cut_ids, row.cuts, strict=True)) if row.cut_ids is not None else {}
                cutoff = np.array([cut.get(i, NONE + 1) for i in q_ids], np.float64)
                rest = np.linalg.norm(q[:, lead:], axis=1)[:, None] * np.linalg.norm(v[:, lead:], axis=1)[None, :]
                bound = q[:, :lead] @ v[:, :lead].T + rest
                keep = bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= cutoff[:, None]  # rounding never drops a candidate
                keep &= q_ids[:, None] != ids[None, :]
                if 20 * keep.sum() < keep.size:
                    i, j = np.nonzero(keep)
                    scores = np.full(keep.shape, NONE)
                    scores[i, j] = exact_pairs(q[i], v[j])
                else:
                    scores = np.where(keep, exact(q, v), NONE)
                scores[scores < np.maximum(cutoff, NONE + 1)[:, None]] = NONE
                at = (row.dim, row.block)
                # each query's best of this chunk; ties at the edge are kept by ranking on (score, id) among all that reach it
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k] if scores.shape[1] > k and (scores > NONE).sum(1).max() > k else None
                if order is None:
                    width = max(1, int((scores > NONE).sum(1).max(initial=0)))
                    order = np.argsort(-(scores > NONE).astype(np.int8), axis=1, kind="stable")[:, :width]
                held[at] = (q_ids, *merged(np.take_along_axis(scores, order, 1), ids[order], held[at][1:] if at in held else None, k))
        for (dim, _), (q_ids, scores, near) in held.items():
            real = scores > NONE
            yield pd.DataFrame({"query_id": np.repeat(q_ids, real.sum(1)), "vec_id": near[real], "score": scores[real]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, to_grid: Callable[[Column], Column] = F.floor, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, lead_share: float = 0.5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query. to_grid makes components whole numbers."""
    spark = vectors.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = lambda df: usable(df, vec_id, embedding, lambda x: to_grid(x).cast("double"))
    rows = grid(vectors)
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)  # a small file is one split, and what follows is heavy
    chunks = staged(packed(rows, "chunk", block), "chunks")
    asked = grid(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    named = packed(asked.coalesce(max(1, spread // 8)), "block", block).select("dim", "block", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    blocks, rounds = in_rounds(named, F.octet_length("q_values"), "blocks", BROADCAST_BYTES)
    longest = blocks.agg(F.max("dim")).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lead = max(1, round(lead_share * longest))

    def met(asked: DataFrame, search: Callable, kind: str, name: str) -> DataFrame:
        """search over all pairs: chunks stay in their tasks, and blocks of queries come to them, some at a time."""
        out = spark.createDataFrame([], kind)
        for r in range(rounds):
            pairs = chunks.join(F.broadcast(asked.where(F.col("round") == r)), "dim")
            with small_batches(spark, 8):
                out = out.unionByName(staged(pairs.mapInPandas(search, kind), name))
        return out

    handed = met(blocks, gather(k, lead), "dim int, block long, query_id long, score long", "handed")
    row = F.row_number().over(W.partitionBy("query_id", "dim", "block").orderBy(F.desc("score")))
    cuts = handed.withColumn("row", row).where(F.col("row") == k).groupBy("dim", "block").agg(F.collect_list("query_id").alias("cut_ids"), F.collect_list("score").alias("cuts"))
    ready = staged(blocks.join(cuts, ["dim", "block"], "left"), "cutoffs")
    found = met(ready, collect(k, lead), "query_id long, vec_id long, score long", "found")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20, lambda x: F.floor(64 * x))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
