"""LEX2 over blocks of chunks: the best chunks of each query by BM25, exactly, without scoring blocks that cannot hold any.

Tokens are staged once. The terms of queries are broadcast, a bounded number of bytes at a time, and meet the tokens in the tasks that hold them. A
task cuts its chunks into blocks; of a block it knows each term's largest part of a score, so the largest score that a query can reach in
it. Only queries whose bound reaches the k-th best score that the task has found are scored there, all chunks of the block at once. k rows
a query and task are handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.functions.text import QUERY_STOP_WORDS, all_tokens, fold_text, without
from lodestrata.sources.staging import in_rounds, small_batches, staged

#: Chunks of a block, terms in a block, and cells of a table of queries by terms.
CHUNKS, TERMS, CELLS = 128, 1 << 16, 1 << 22


def stage_tokens(chunks: DataFrame) -> DataFrame:
    """chunk_id, tokens (TXT2), phrase (TXT3) of chunks with their text, once for all that needs them."""
    every = chunks.select("chunk_id", all_tokens(fold_text(F.col("text"))).alias("every"))
    none = F.array().cast("array<string>")
    tokens = F.coalesce(without(F.col("every"), QUERY_STOP_WORDS), none)
    return staged(every.select("chunk_id", tokens.alias("tokens"), F.array_join("every", " ").alias("phrase")), "tokens", 10_000)


def query_terms(queries: DataFrame, tokens: DataFrame, asked_tokens, epsilon: float) -> tuple[DataFrame, float]:
    """query_id, tokens, weights (times in the query * idf) of the terms that stand in some chunk; the average length of a chunk."""
    vocabulary = staged(tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df")), "vocabulary")
    size = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    idf = F.log(F.lit(size["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf = vocabulary.agg(F.avg(idf)).first()[0] or 0.0
    asked = queries.select("query_id", F.explode(asked_tokens).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    weighted = asked.join(vocabulary, "token").select("query_id", "token", (F.col("times") * F.when(idf < 0, F.lit(epsilon * mean_idf)).otherwise(idf)).alias("weight"))
    by_query = weighted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("own"))
    average = size["tokens"] / size["n"] if size["n"] else 0.0
    return by_query.select("query_id", F.col("own.token").alias("tokens"), F.col("own.weight").alias("weights")), average


class Group:
    """Queries that are scored together: their terms' places and a table of weights."""

    def __init__(self, rows: list[tuple], n_terms: int):
        self.names = [r[0] for r in rows]
        columns = np.unique(np.concatenate([r[1] for r in rows]))
        self.place = np.full(n_terms, -1, np.int64)
        self.place[columns] = np.arange(len(columns))
        self.weights, self.there = np.zeros((len(rows), len(columns))), np.zeros((len(rows), len(columns)), bool)
        for i, (_, own, weights) in enumerate(rows):
            self.weights[i, self.place[own]] = weights
            self.there[i, self.place[own]] = True
        self.positive = bool((self.weights[self.there] > 0).all())
        self.least = np.full(len(rows), -np.inf)  # the k-th best score found so far
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def score(self, rows: np.ndarray, columns: np.ndarray, parts: np.ndarray, names: np.ndarray, k: int) -> int:
        """Take in a block: entries (row, column of a term, its part of a score) of chunks `names`; how many queries were scored."""
        place = self.place[columns]
        mine = place >= 0
        used, at = np.unique(place[mine], return_inverse=True)
        if not len(used):
            return 0
        table = np.zeros((len(names), len(used)))
        table[rows[mine], at] = parts[mine]
        weights = self.weights[:, used]
        bound = np.maximum(weights, 0) @ table.max(0)
        asked = np.flatnonzero((bound >= self.least - 1e-8) & self.there[:, used].any(1))
        scores = weights[asked] @ table.T
        found = scores > 0 if self.positive else (self.there[np.ix_(asked, used)].astype(float) @ (table.T > 0)) > 0
        found &= scores >= self.least[asked, None] - 2e-9
        for i in np.flatnonzero(found.any(1)):
            self._keep(int(asked[i]), scores[i, found[i]], names[found[i]], k)
        return len(asked)

    def _keep(self, i: int, scores: np.ndarray, names: np.ndarray, k: int) -> None:
        if i in self.best:
            scores, names = np.concatenate([self.best[i][0], scores]), np.concatenate([self.best[i][1], names])
        if len(scores) > k:
            some = scores >= np.partition(scores, -k)[-k] - 2e-9
            scores, names = scores[some], names[some]
            order = np.lexsort((names, -np.round(scores, 9)))[:k]
            scores, names = scores[order], names[order]
        self.best[i] = scores, names
        if len(scores) == k:
            self.least[i] = scores.min()


def groups_of(rows: list[tuple], n_terms: int) -> list[Group]:
    """Queries in groups whose tables of weights stay under CELLS; a query alone may be beyond."""
    out: list[Group] = []
    own: list[tuple] = []
    terms = 0
    for row in rows:
        if own and (len(own) + 1) * (terms + len(row[1])) > CELLS:
            out.append(Group(own, n_terms))
            own, terms = [], 0
        own.append(row)
        terms += len(row[1])
    return [*out, Group(own, n_terms)] if own else out


def scorer(asked, k: int, average: float, k1: float, b: float, query_type: pa.DataType) -> Callable:
    """asked: a broadcast of (all terms, [(query, places of its terms, weights)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rows = asked.value
        groups, known, kind = groups_of(rows, len(terms)), pa.array(terms, pa.string()), None
        for batch in batches:
            names, lists = batch.column(0), batch.column(1)
            kind = names.type
            lengths = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
            mine = columns >= 0
            entries, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths)[mine] * len(terms) + columns[mine], return_counts=True)
            row, column = entries // max(len(terms), 1), entries % max(len(terms), 1)
            parts = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / average)) if average else tf * 0.0
            ids = np.array(names.to_pylist(), object)
            starts = np.searchsorted(row, np.arange(len(lengths) + 1))
            first = 0
            while first < len(lengths):
                end = min(first + CHUNKS, max(first + 1, int(np.searchsorted(starts, starts[first] + TERMS, side="right")) - 1))
                own = slice(starts[first], starts[end])
                for group in groups:
                    group.score(row[own] - first, column[own], parts[own], ids[first:end], k)
                first = end
        for group in groups:
            for i, (scores, ids) in group.best.items():
                columns = [pa.array([group.names[i]] * len(ids), query_type), pa.array(ids.tolist(), kind), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

    return run


def best_chunks(queries: DataFrame, tokens: DataFrame, asked_tokens, k: int, k1: float, b: float, epsilon: float) -> DataFrame:
    """query_id, chunk_id, score of the k best chunks of each query of each task; the best of all are among them.

    Equal scores (to the 9th place) go by chunk_id. Only chunks that share a term with the query count.
    """
    spark = queries.sparkSession
    terms, average = query_terms(queries, tokens, asked_tokens, epsilon)
    terms, rounds = in_rounds(terms, F.size("tokens") * 32 + 64, "query-terms")
    types = [queries.schema["query_id"].dataType, tokens.schema["chunk_id"].dataType]
    kind = f"query_id {types[0].simpleString()}, chunk_id {types[1].simpleString()}, score double"
    found = spark.createDataFrame([], kind)
    for r in range(rounds):
        own = terms.where(F.col("round") == r).collect()  # of one round: bounded
        every = sorted({t for row in own for t in row["tokens"]})
        place = {t: i for i, t in enumerate(every)}
        rows = [(row["query_id"], np.array([place[t] for t in row["tokens"]], np.int64), np.array(row["weights"])) for row in own]
        asked = spark.sparkContext.broadcast((every, rows))
        with small_batches(spark, 1000):
            found = found.unionByName(tokens.select("chunk_id", "tokens").mapInArrow(scorer(asked, k, average, k1, b, to_arrow_type(types[0])), kind))
    return found
