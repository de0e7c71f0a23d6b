"""Batch retrieval: owner filter, embeddings, exact and approximate neighbours, BM25, fusion, rerank, contexts, citations.

Candidate tables are (query_id, chunk_id, score, rank); chunk text is joined again only where a step reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import normalize_query, normalized_phrase, tokenize
from lodestrata.operators import lexical
from lodestrata.sources.staging import in_rounds, staged

# --- fixed values ---
EMBEDDING_STOP_WORDS = ["a", "an", "and", "are", "document", "documents", "find", "for", "in", "is", "my", "of", "on", "the", "this", "to", "what"]
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
VECTOR_TOP_K, LEXICAL_TOP_K, RERANK_TOP_K, FINAL_TOP_K, MIN_SIMILARITY = 20, 20, 10, 5, 0.25
# --- end of fixed values ---
#: Texts whose vectors a task holds at once.
EMBEDDED = 1000


def filter_owners(df: DataFrame, ids: list | DataFrame | None, column: str = "document_id") -> DataFrame:
    """FIL1: None keeps all, an empty list nothing; a DataFrame of ids is joined."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.toDF(column), column, "left_semi")
    return df.where(F.col(column).isin(*ids)) if ids else df.where(F.lit(False))


def similarity_floor(df: DataFrame, min_score: float, distance: str = "distance", tie: str = "chunk_id") -> DataFrame:
    """FIL2: score from distance, weak candidates dropped, ranks given anew."""
    scored = df.withColumn("score", F.least(F.greatest(1 - F.col(distance), F.lit(0.0)), F.lit(1.0))).where(F.col("score") >= min_score)
    return rank_candidates(scored, [F.col(distance), F.col(tie)])


def rank_candidates(df: DataFrame, order: list[Column], k: int | None = None) -> DataFrame:
    """WIN1: ranks from 1 without ties or gaps per query, the first k if given."""
    out = df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def resolve_matches(matches: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """JOI1: matches that the store does not know are dropped."""
    return matches.join(store, key, "inner")


def embed(df: DataFrame, text_col: str, embedder: Callable[[list[str]], list], out: str = "embedding") -> DataFrame:
    """UDF1: a batch embedder over a text column; it must give one non-empty vector for each text."""
    schema = f"{df._jdf.schema().toDDL()}, `{out}` array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), EMBEDDED):
                own = part.iloc[i : i + EMBEDDED]
                texts = own[text_col].fillna("").tolist()
                vectors = embedder(texts)
                if len(vectors) != len(texts) or any(len(v) == 0 for v in vectors):
                    raise ValueError("the embedder must return one non-empty vector for each text")
                yield own.assign(**{out: list(vectors)})

    return df.mapInPandas(run, schema)


def hashed_slots(dim: int = 256, held: int = 200_000) -> Callable[[str], list[int]]:
    """The slot of each token of a text by hash; the first one where there is no token."""
    import re

    pattern, stop, known = re.compile(r"\w+"), frozenset(EMBEDDING_STOP_WORDS), {}

    def slot(token: str) -> int:
        if (at := known.get(token)) is None:
            if len(known) >= held:
                known.clear()
            at = known[token] = int.from_bytes(hashlib.sha256(token.encode()).digest()[:2], "big") % dim
        return at

    return lambda text: [slot(t) for t in pattern.findall(text.casefold()) if t not in stop] or [0]


def hashed_embedder(dim: int = 256, held: int = 200_000) -> Callable[[list[str]], list[np.ndarray]]:
    """VEC1: counts of tokens by hash, of length 1; the first unit vector where there is no token."""
    slots_of = hashed_slots(dim, held)

    def run(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.bincount(slots_of(text), minlength=dim).astype(float)
            out.append(v / np.linalg.norm(v))
        return out

    return run


def embed_hashed(df: DataFrame, text_col: str, dim: int = 256, out: str = "embedding") -> DataFrame:
    return embed(df, text_col, hashed_embedder(dim), out)


def blocks(vectors: DataFrame, names: str, values: str, rows: int) -> DataFrame:
    """(id string, embedding, block int) rows as packets of up to `rows` vectors of one length and block: dim, block, names, values."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}

        def packet(key: tuple[int, int]) -> pd.DataFrame:
            ids, own = zip(*held.pop(key), strict=True)
            return pd.DataFrame({"dim": [key[0]], "block": [key[1]], names: [list(ids)], values: [np.stack(own).tobytes()]})

        for part in parts:
            for i, v, block in zip(part["id"], part["embedding"], part["block"], strict=True):
                own = np.asarray([] if v is None else v, np.float64)
                key = (len(own), block)
                held.setdefault(key, []).append((i, own))
                if len(held[key]) == rows:
                    yield packet(key)
        for key in list(held):
            yield packet(key)

    return vectors.mapInPandas(pack, f"dim int, block int, {names} array<string>, {values} binary")


class Best:
    """The k best (distance, name) of each of n rows among all that are taken in, smaller ones being better."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, np.inf)  # the k-th best distance so far
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most, self.cuts = 0, max(1 << 18, 2 * n * k), 0

    def take(self, rows: np.ndarray, distances: np.ndarray, names: np.ndarray) -> None:
        some = distances <= self.least[rows]
        if some.any():
            self.held.append((rows[some], distances[some], names[some]))
            self.size += len(self.held[-1][0])
            if self.size > self.most:
                self.cut()

    def cut(self) -> None:
        if not self.held:
            return
        rows, distances, names = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((names, distances, rows))
        rows, distances, names = rows[order], distances[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last, some = place == self.k - 1, place < self.k
        self.least[rows[last]] = distances[last]
        self.cuts += 1
        self.held, self.size = [(rows[some], distances[some], names[some])], int(some.sum())

    def found(self, some: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """rows, distances, names of the best, `some` at a time."""
        self.cut()
        for i in range(0, self.size, some):
            yield tuple(x[i : i + some] for x in self.held[0])


def nearest(asked, k: int, block: int) -> Callable:
    """The k nearest of each query by (cosine distance, id), kept as a running best per task.

    asked: a broadcast of [(dim, names, values)] of blocks of queries. Vectors are taken `block` at a time, those of one length together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(dim, names, np.frombuffer(values).reshape(len(names), dim)) for dim, names, values in asked.value]
        best = [[([], [])] * len(names) for _, names, _ in queries]  # of each query: distances, ids
        least = [np.full(len(names), np.inf) for _, names, _ in queries]  # the k-th best distance so far

        def meet(n: int, names: np.ndarray, v: np.ndarray) -> None:
            dim, q_names, q = queries[n]
            if dim == v.shape[1] and dim:
                qn, vn = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.round(np.maximum(0.0, 1 - (q @ v.T) / (qn[:, None] * vn[None, :])), 12)
                d[(qn == 0)[:, None] | (vn == 0)[None, :]] = 1.0
            else:
                d = np.full((len(q_names), len(names)), 2.0)
            edge = np.minimum(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1], least[n])
            close = d <= edge[:, None]
            for i in np.flatnonzero(close.any(1)):
                own = sorted(zip([*best[n][i][0], *d[i, close[i]].tolist()], [*best[n][i][1], *names[close[i]]], strict=True))[:k]
                best[n][i] = tuple(zip(*own, strict=True))
                if len(own) == k:
                    least[n][i] = own[-1][0]

        for batch in batches:
            names, lists = np.array(batch.column("id").to_pylist(), object), batch.column("embedding")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            starts, flat = np.cumsum(lengths) - lengths, lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                for i in range(0, len(rows), block):
                    at = rows[i : i + block]
                    v = flat[starts[at][:, None] + np.arange(dim)]
                    for n in range(len(queries)):
                        meet(n, names[at], v)
        for (_, names, _), own in zip(queries, best, strict=True):
            for i in range(0, len(names), block):
                rows = [(name, x, d) for name, found in zip(names[i : i + block], own[i : i + block], strict=True) for d, x in zip(*found, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["query_id", "vector_id", "distance"])

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int, owners: list | None = None, block: int = 1024) -> DataFrame:
    """VEC2/JOI2: query_id, vector_id, distance, rank of the k nearest vectors of each query, exactly.

    Queries are packed into blocks and broadcast, a bounded number of bytes at a time, and meet the vectors in the tasks that hold
    them: the work is spread as the vectors are, a task holds an Arrow batch of vectors beside the queries of a round, and only k rows
    a query and task are shuffled for the final rank. Lengths that differ give distance 2, a zero vector 1. Distances are rounded to
    the 12th place: equal vectors are ties wherever they stand in a block.
    """
    spark, vectors = queries.sparkSession, filter_owners(vectors, owners, "owner_id")
    slim = lambda df, key: df.select(F.col(key).cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked, rounds = in_rounds(blocks(slim(queries, "query_id").withColumn("block", F.lit(0)), "q_names", "q_values", block).drop("block"), F.octet_length("q_values"), "queries")
    held = slim(vectors, "vector_id")
    if rounds > 1:
        held = staged(held, "vectors")
    kind = "query_id string, vector_id string, distance double"
    found = spark.createDataFrame([], kind)
    for r in range(rounds):
        own = [(row["dim"], list(row["q_names"]), bytes(row["q_values"])) for row in asked.where(F.col("round") == r).collect()]  # of one round: bounded
        asked_now = spark.sparkContext.broadcast(own)
        met = held.mapInArrow(nearest(asked_now, k, block), kind)
        if rounds > 1:  # a round's queries are gone when its rows are staged
            met = staged(met, "nearest", 10_000)
            asked_now.destroy()
        found = found.unionByName(met)
    return rank_candidates(found, [F.col("distance"), F.col("vector_id")], k)


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, length, token, tf."""
    tokens = chunks.select("chunk_id", tokenize(F.col("text")).alias("tokens"))
    return tokens.select("chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy("chunk_id", "length", "token").agg(F.count("*").alias("tf"))


def vocabulary_of(tf: DataFrame) -> DataFrame:
    """token, df (chunks with it), tokens (how often it stands)."""
    return tf.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tokens"))


def stats_of(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: n (chunks, those without tokens too), avg_length, vocabulary, mean_idf."""
    n = chunks.agg(F.count("*").alias("n"))
    every = vocabulary.crossJoin(F.broadcast(n))
    return every.agg(F.first("n").alias("n"), (F.sum("tokens") / F.first("n")).alias("avg_length"), F.count("*").alias("vocabulary"), F.avg(raw_idf()).alias("mean_idf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """AGG8: one row of N, average length, vocabulary size and mean idf."""
    return stats_of(chunks, vocabulary_of(postings(chunks)))


def raw_idf() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def bm25(queries: DataFrame, chunks: DataFrame, k: int, k1: float = K1, b: float = B, epsilon: float = EPSILON, tokens: DataFrame | None = None) -> DataFrame:
    """LEX2: query_id, chunk_id, score, rank. Repeated query tokens count again; only chunks that share a token are candidates.

    tokens: those of chunks, as lexical.stage_tokens gives them, if they are staged already.
    """
    tokens = lexical.stage_tokens(chunks) if tokens is None else tokens
    scores = lexical.best_chunks(queries, tokens, tokenize(F.col("text")), k, k1, b, epsilon)
    return rank_candidates(scores, [F.desc(F.round("score", 9)), F.col("chunk_id")], k)  # sums in another order are still ties


def rrf(vector: DataFrame, lexical: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """FUS1: query_id, chunk_id, vector_rank, lexical_rank, rrf_score, rank."""
    if rrf_k < 1:
        raise ValueError("rrf_k must be at least 1")
    # joined, not united with null columns: where one plan holds the fusion several times, adaptive reuse took the ranks of one list for the other's
    first = lambda df, name: df.groupBy("query_id", "chunk_id").agg(F.min("rank").alias(name))
    lists = first(vector, "vector_rank").join(first(lexical, "lexical_rank"), ["query_id", "chunk_id"], "full_outer")
    term = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = lists.withColumn("rrf_score", term("vector_rank") + term("lexical_rank"))
    return rank_candidates(scored, [F.desc("rrf_score"), F.least("vector_rank", "lexical_rank"), F.col("chunk_id")])


def rerank(queries: DataFrame, fused: DataFrame, k: int = RERANK_TOP_K) -> DataFrame:
    """RRK1: fused candidates with their `text`, or `tokens` and `phrase`, by coverage, identifiers, phrase and fusion score."""
    if "tokens" not in fused.columns:
        fused = fused.withColumns({"tokens": tokenize(F.col("text")), "phrase": normalized_phrase(F.col("text"))})
    asked = queries.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("q"), normalized_phrase(F.col("text")).alias("asked"))
    asked = asked.withColumn("ids", F.filter("q", lambda t: t.rlike("[0-9]")))
    found = fused.join(asked, "query_id")
    share = lambda part: F.size(F.array_intersect(part, "tokens")) / F.size(part)
    found = found.withColumn("query_coverage", F.when(F.size("q") > 0, share(F.col("q"))).otherwise(0.0))
    found = found.withColumn("exact_phrase", (F.col("asked") != "") & F.contains("phrase", "asked"))
    top = F.max("rrf_score").over(W.partitionBy("query_id"))
    identifiers = F.when(F.size("ids") > 0, share(F.col("ids"))).otherwise(F.col("query_coverage"))
    score = F.least(F.lit(1.0), 0.55 * F.col("query_coverage") + 0.20 * identifiers + 0.15 * F.col("exact_phrase").cast("double") + 0.10 * F.when(top > 0, F.col("rrf_score") / top).otherwise(0.0))
    scored = found.withColumn("score", score).drop("q", "ids", "asked", "tokens", "phrase", "rank")
    return rank_candidates(scored, [F.desc(F.round("score", 9)), F.desc("rrf_score"), F.col("chunk_id")], k)


def select_context(df: DataFrame, k: int = FINAL_TOP_K) -> DataFrame:
    """FIL3: the first k with full provenance, each chunk once."""
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    sound = df.where(filled("document_id") & filled("filename") & filled("chunk_id") & (F.col("page_number") >= 1))
    once = sound.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("rank"))).where("_n = 1").drop("_n")
    return rank_candidates(once, [F.col("rank"), F.col("chunk_id")], k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", embeddings: DataFrame | None = None, owners: list | None = None, top_k: int = FINAL_TOP_K, dim: int = 256, debug: bool = False):
    """HYB1: contexts of each query; with debug, also each stage's candidates (WIN6).

    queries: query_id, text. chunks: chunk_id, document_id, filename, page_number, chunk_index, text.
    """
    if mode not in ("hybrid", "vector_only"):
        raise ValueError(mode)
    asked = queries.select("query_id", normalize_query(F.col("text")).alias("text"))
    chunks = filter_owners(chunks, owners)
    vectors = embeddings if embeddings is not None else embed_hashed(chunks.select(F.col("chunk_id").alias("vector_id"), "text"), "text", dim).drop("text")
    near = knn(embed_hashed(asked, "text", dim), vectors, VECTOR_TOP_K).select("query_id", F.col("vector_id").alias("chunk_id"), "distance")
    # the lists are small, and each is read several times
    vector = staged(similarity_floor(resolve_matches(near, chunks.select("chunk_id"), "chunk_id"), MIN_SIMILARITY), "vector-list")
    stages = [vector.select("query_id", "chunk_id", "score", "rank", F.lit("vector").alias("stage"))]
    if mode == "vector_only":
        found = vector.join(chunks, "chunk_id")
    else:
        tokens = lexical.stage_tokens(chunks)
        words = bm25(asked, chunks, LEXICAL_TOP_K, tokens=tokens)
        words = staged(words.select(F.col("query_id").cast("string").alias("query_id"), "chunk_id", "score", "rank"), "lexical-list")
        fused = rrf(vector, words)
        ordered = rerank(asked.withColumn("query_id", F.col("query_id").cast("string")), fused.join(tokens, "chunk_id"))
        ordered = staged(ordered, "reranked-list")
        found = ordered.join(chunks, "chunk_id")
        stages.append(words.withColumn("stage", F.lit("lexical")))
        stages.append(fused.select("query_id", "chunk_id", F.col("rrf_score").alias("score"), "rank", F.lit("fused").alias("stage")))
        stages.append(ordered.select("query_id", "chunk_id", "score", "rank", F.lit("reranked").alias("stage")))
    final = select_context(found, min(top_k, FINAL_TOP_K))
    if not debug:
        return final
    stages.append(final.select("query_id", "chunk_id", "score", "rank", F.lit("final").alias("stage")))
    return final, retrieval_debug(stages)


def retrieval_debug(stages: list[DataFrame]) -> DataFrame:
    """WIN6: all stages' candidates in one table."""
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out.select("query_id", "stage", "rank", "chunk_id", "score")


def build_citations(results: DataFrame) -> DataFrame:
    """CIT1: citation_id and locator of document chunks (chunk_id, filename, page_number) or media segments (segment_id, ..., times)."""
    from lodestrata.functions.text import seconds

    if "segment_id" in results.columns:
        where = F.concat(F.col("filename"), F.lit(", "), seconds(F.col("start_seconds")), F.lit("s–"), seconds(F.col("end_seconds")), F.lit("s"))
        return results.withColumn("citation_id", F.concat(F.lit("citation_"), "segment_id")).withColumn("locator", where)
    where = F.concat(F.col("filename"), F.lit(", page "), F.col("page_number").cast("string"))
    return results.withColumn("citation_id", F.concat(F.lit("citation_"), "chunk_id")).withColumn("locator", where)
