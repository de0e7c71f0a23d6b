"""VEC3: approximate neighbours by an inverted file whose rows are product-quantised residuals.

`build_index` fits centroids and codebooks on a bounded sample of the vectors and puts every vector, normalised, into the list of its nearest
centroid as a code: what is left of it after the centroid, cut into parts, each part named by its nearest codebook entry; the vector itself
lies beside it. A search estimates distances from tables, one look-up for each part, in the lists nearest to the query, and scores only the best
of the estimates exactly. How many lists and how many of the sample's estimates are taken is set on the sample, so that of its own neighbours
`target` are found; each query's cutoff is the last of so many estimates of the sample's rows. As the sample is a part of the index, at least
as many rows are scored, and of a larger index so many times more.

Queries are broadcast, a bounded number of bytes at a time, and meet the lists in the tasks that hold them; only k rows a query and task go on.

Vectors that are null, zero or of another length than most have no code. They have a fixed distance to all others (1 or 2), so the first k of
them by id stand for all. Queries of that kind are searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.retrieval import Best, knn, rank_candidates
from lodestrata.sources.staging import in_rounds, staged

SAMPLE, LISTS, PARTS, CODES, PACKET, ASKED = 20_000, 512, 16, 256, 4096, 200
#: A list is packed by so many tasks at least, if they have rows of it.
SALT = 8
#: Queries that meet a packet at once; pairs that are scored at once.
MET, PAIRS = 512, 1 << 15


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # parts x codes x width
    dim: int  # of the vectors; parts * width may be more

    def padded(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.books.shape[0] * self.books.shape[2] - v.shape[1])))

    def assign(self, v: np.ndarray) -> np.ndarray:
        return closest(v, self.centroids)

    def order(self, v: np.ndarray) -> np.ndarray:
        """Of each vector, the rank of each list from the nearest, which is 0."""
        return squares(v, self.centroids).argsort(1, kind="stable").argsort(1, kind="stable")

    def encode(self, v: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.padded(v - self.centroids[lists]).reshape(len(v), *self.books.shape[::2])
        return np.stack([closest(rest[:, m], self.books[m]) for m in range(len(self.books))], axis=1).astype(np.uint8)

    def estimates(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the vectors of one list that codes stand for."""
        rest = self.padded(queries - self.centroids[which]).reshape(len(queries), *self.books.shape[::2])
        out = np.zeros((len(queries), len(codes)))
        for m, book in enumerate(self.books):
            out += squares(rest[:, m], book)[:, codes[:, m]]
        return out


@dataclass(frozen=True)
class Index:
    quantiser: Quantiser | None
    packets: DataFrame  # list, n, names, codes, units
    odd: DataFrame  # vector_id and distance of the first rows without a code
    probes: int
    short: int  # estimates of the sample that are taken
    lists: np.ndarray | None = None  # of the sample's rows
    codes: np.ndarray | None = None


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0.0)


def closest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(a[i : i + 4096], b).argmin(1) for i in range(0, len(a), 4096)] or [np.zeros(0, np.int64)])


def centres(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means; fewer distinct points are their own centres."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    found = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = closest(points, found)
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found)
    return found


def fit(sample: np.ndarray, lists: int, parts: int, seed: int) -> Quantiser:
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    centroids = centres(sample, lists, rng)
    parts = min(parts, dim)
    width = -(-dim // parts)
    rest = np.pad(sample - centroids[closest(sample, centroids)], ((0, 0), (0, parts * width - dim))).reshape(len(sample), parts, width)
    books = [centres(rest[:, m], CODES, rng) for m in range(parts)]
    # a book of fewer entries is filled with ones that nothing is nearest to first
    return Quantiser(centroids, np.stack([np.concatenate([b, np.repeat(b[:1], CODES - len(b), axis=0)]) for b in books]), dim)


def estimated(quantiser: Quantiser, order: np.ndarray, probes: int, queries: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Estimates of rows, given by lists and codes, for queries; infinite outside the first `probes` lists of the query, which order ranks."""
    out = np.full((len(queries), len(lists)), np.inf)
    for which in np.unique(lists):
        rows_of, seen = np.flatnonzero(lists == which), np.flatnonzero(order[:, which] < probes)
        out[np.ix_(seen, rows_of)] = quantiser.estimates(queries[seen], which, codes[rows_of])
    return out


def calibrate(quantiser: Quantiser, sample: np.ndarray, lists: np.ndarray, codes: np.ndarray, k: int, target: float) -> tuple[int, int]:
    """Lists to look into and estimates to score, so that a share of `target` of the sample's own k neighbours is found."""
    asked = sample[:ASKED]
    own = np.arange(len(asked))
    exact = -(asked @ sample.T)
    exact[own, own] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(quantiser.centroids), 1
    true = np.argsort(exact, axis=1, kind="stable")[:, :k]
    order = quantiser.order(asked)
    place = np.sort(np.take_along_axis(order, lists[true], 1).ravel())  # of each neighbour's list among the query's
    at = lambda values, share: values[min(len(values) - 1, int(np.ceil(share * len(values))) - 1)]
    probes = int(at(place, (1 + target) / 2)) + 1
    found = estimated(quantiser, order, probes, asked, lists, codes)
    found[own, own] = np.inf
    of_true = np.take_along_axis(found, true, 1)
    better = np.sort(np.where(np.isfinite(of_true), (found[:, None, :] < of_true[:, :, None]).sum(2), len(sample)).ravel())
    return probes, max(k + 1, int(at(better, target)) + 2)  # the query itself may be among the vectors


def unit_rows(part: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of length dim that is finite and not zero, and those vectors at length 1."""
    ok = np.array([v is not None and len(v) == dim for v in part["embedding"]], bool)
    v = np.stack([np.asarray(x, np.float64) for x in part["embedding"][ok]]) if ok.any() else np.zeros((0, dim))
    size = np.linalg.norm(v, axis=1)
    good = np.isfinite(size) & (size > 0)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, v[good] / size[good, None]


def build_index(vectors: DataFrame, k: int = 10, target: float = 0.95, lists: int | None = None, parts: int = PARTS, sample: int = SAMPLE, seed: int = 3) -> Index:
    """An index of all vectors (vector_id, embedding). sample: rows, drawn by a hash of their ids, that are brought to the driver to fit it."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col("vector_id").cast("string").alias("vector_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = slim.where("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count()
    common = sizes.orderBy(F.desc("count"), "dim").first()
    codes_of = "list int, vector_id string, code binary, unit binary, kind double"
    packed = "list int, n int, names array<string>, codes binary, units binary"
    if common is None:
        packets = spark.createDataFrame([], packed)
        return Index(None, packets, slim.select("vector_id", F.lit(2.0).alias("distance")).limit(0), 0, 0)
    dim, rows = common["dim"], common["count"]
    draw = F.pmod(F.xxhash64("vector_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * sample / rows))
    drawn = slim.where((F.size("embedding") == dim) & draw).limit(sample).toPandas()
    own = unit_rows(drawn, dim)[1]
    quantiser = fit(own, lists or max(1, min(LISTS, round(len(own) ** 0.5))), parts, seed) if len(own) else None
    own_lists = quantiser.assign(own) if quantiser else None
    own_codes = quantiser.encode(own, own_lists) if quantiser else None
    probes, short = calibrate(quantiser, own, own_lists, own_codes, k, target) if quantiser else (0, 0)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            ok, v = unit_rows(part, dim) if quantiser else (np.zeros(len(part), bool), None)
            which, codes, units = np.full(len(part), -1), np.full(len(part), None, object), np.full(len(part), None, object)
            if ok.any():
                which[ok] = quantiser.assign(v)
                codes[ok] = [c.tobytes() for c in quantiser.encode(v, which[ok])]
                units[ok] = [u.tobytes() for u in v]
            kind = [np.nan if good else 1.0 if e is not None and len(e) == dim else 2.0 for good, e in zip(ok, part["embedding"], strict=True)]
            yield pd.DataFrame({"list": which, "vector_id": part["vector_id"], "code": codes, "unit": units, "kind": kind})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def packet(which: int) -> pd.DataFrame:
            names, codes, units = zip(*held.pop(which), strict=True)
            return pd.DataFrame({"list": [which], "n": [len(names)], "names": [list(names)], "codes": [b"".join(codes)], "units": [b"".join(units)]})

        for part in batches:
            for which, *row in zip(part["list"], part["vector_id"], part["code"], part["unit"], strict=True):
                held.setdefault(which, []).append(row)
                if len(held[which]) == PACKET:
                    yield packet(which)
        for which in list(held):
            yield packet(which)

    coded = staged(slim.mapInPandas(encode, codes_of), "coded")
    dealt = coded.where("list >= 0").withColumn("salt", F.pmod(F.xxhash64("vector_id"), F.lit(SALT))).repartition("list", "salt").drop("salt", "kind")
    packets = staged(dealt.mapInPandas(pack, packed), "packets")
    kinds = [coded.where(F.col("kind") == x).select("vector_id", F.col("kind").alias("distance")).orderBy("vector_id").limit(k) for x in (1.0, 2.0)]
    return Index(quantiser, packets, staged(kinds[0].unionByName(kinds[1]), "uncoded"), probes, short, own_lists, own_codes)


def asked_of(index: Index, queries: DataFrame) -> DataFrame:
    """Blocks of queries: names, units, cutoffs; of queries without a code names only."""
    quantiser, probes, short, lists, codes = index.quantiser, index.probes, index.short, index.lists, index.codes

    def cutoff(v: np.ndarray) -> np.ndarray:
        if short > len(lists):
            return np.full(len(v), np.inf)
        found = estimated(quantiser, quantiser.order(v), probes, v, lists, codes)
        # a margin over what sums in other blocks differ by
        return np.partition(found, short - 1, axis=1)[:, short - 1] * (1 + 1e-9) + 1e-12

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every in batches:
            for i in range(0, len(every), MET):
                part = every.iloc[i : i + MET]
                ok, v = unit_rows(part, quantiser.dim) if quantiser else (np.zeros(len(part), bool), np.zeros((0, 1)))
                names = part["query_id"].to_numpy()
                if len(v):
                    yield pd.DataFrame({"names": [names[ok].tolist()], "units": [v.tobytes()], "cutoffs": [cutoff(v).tobytes()]})
                if not ok.all():
                    yield pd.DataFrame({"names": [names[~ok].tolist()], "units": [None], "cutoffs": [None]})

    slim = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInPandas(run, "names array<string>, units binary, cutoffs binary")


def scorer(index: Index, asked, k: int):
    """asked: a broadcast of (names, units, cutoffs) of queries."""
    quantiser, probes = index.quantiser, index.probes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_names, queries, cutoffs = asked.value
        looks = np.concatenate([quantiser.order(queries[i : i + 4096]) < probes for i in range(0, len(queries), 4096)])  # query x list
        best, met, scored = Best(len(queries), k), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for part in batches:
            for row in part.itertuples():
                names, codes, units = np.array(row.names, object), np.frombuffer(row.codes, np.uint8).reshape(row.n, -1), np.frombuffer(row.units).reshape(row.n, -1)
                every = np.flatnonzero(looks[:, row.list])
                met[every] += row.n
                for i in range(0, len(every), MET):
                    own = every[i : i + MET]
                    close = quantiser.estimates(queries[own], row.list, codes) <= cutoffs[own, None]
                    scored[own] += close.sum(1)
                    at, which = np.nonzero(close)
                    for j in range(0, len(at), PAIRS):
                        a, v = own[at[j : j + PAIRS]], which[j : j + PAIRS]
                        best.take(a, np.round(np.maximum(0.0, 1 - np.einsum("ij,ij->i", queries[a], units[v])), 12), names[v])
        some = np.flatnonzero(met)
        yield pd.DataFrame({"query_id": q_names[some], "vector_id": None, "distance": None, "estimated": met[some], "scored": scored[some]})
        for rows, distances, names in best.found(1 << 16):
            yield pd.DataFrame({"query_id": q_names[rows], "vector_id": names, "distance": distances, "estimated": None, "scored": None})

    return run


@dataclass(frozen=True)
class Met:
    blocks: DataFrame  # of queries, as asked_of gives them
    found: DataFrame  # query_id, vector_id, distance, estimated, scored: a task's k nearest of a query; without vector_id what it estimated and scored


def meet(index: Index, queries: DataFrame, k: int) -> Met:
    """What the lists say to queries. A round's queries are gone from driver and executors when its rows are staged."""
    spark, kind = queries.sparkSession, "query_id string, vector_id string, distance double, estimated long, scored long"
    blocks, rounds = in_rounds(asked_of(index, queries), F.coalesce(F.octet_length("units"), F.lit(0)) + F.size("names") * 48, "asked")
    found = spark.createDataFrame([], kind)
    for r in range(rounds):
        own = blocks.where((F.col("round") == r) & F.col("units").isNotNull()).collect()  # of one round: bounded
        if own:
            names = np.array([name for row in own for name in row["names"]], object)
            units, cutoffs = (np.frombuffer(b"".join(row[c] for row in own)) for c in ("units", "cutoffs"))
            asked = spark.sparkContext.broadcast((names, units.reshape(len(names), -1), cutoffs))
            found = found.unionByName(staged(index.packets.mapInPandas(scorer(index, asked, k), kind), "met", 4))
            asked.destroy()
    return Met(blocks, found)


def search(index: Index, queries: DataFrame, vectors: DataFrame, k: int, met: Met | None = None) -> DataFrame:
    """query_id, vector_id, distance, rank of about the k nearest vectors; those that are found have their exact distances.

    vectors: those of the index, vector_id being unique in it. met: what `meet` gave for these queries and k, if it was asked already.
    """
    met = met or meet(index, queries, k)
    kinds = met.blocks.select(F.explode("names").alias("query_id"), F.col("units").isNotNull().alias("coded"))
    uncoded = kinds.where("coded").select("query_id").crossJoin(F.broadcast(index.odd))  # 2 * k rows at most
    scored = met.found.where("vector_id is not null").select("query_id", "vector_id", "distance")
    near = rank_candidates(scored.unionByName(uncoded.select("query_id", "vector_id", "distance")), [F.col("distance"), F.col("vector_id")], k)
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    rest = asked.join(kinds.where("not coded").select("query_id"), "query_id")
    return near.unionByName(knn(rest, vectors, k).select(near.columns))


def knn_approx(queries: DataFrame, vectors: DataFrame, k: int, **fitted) -> DataFrame:
    """VEC3 over vectors that are indexed for it; `fitted` goes to build_index."""
    return search(build_index(vectors, k, **fitted), queries, vectors, k)


def work(index: Index, queries: DataFrame, met: Met | None = None) -> DataFrame:
    """query_id, estimated, scored: how many vectors each query with a code meets in its lists, and how many it scores exactly."""
    found = (met or meet(index, queries, 1)).found.where("vector_id is null")
    return found.groupBy("query_id").agg(F.sum("estimated").alias("estimated"), F.sum("scored").alias("scored"))
