import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import evaluate as ev
from lodestrata.operators import neighbours as n
from lodestrata.operators import retrieval as r
from lodestrata.sources import staging


def chunks(spark, texts):
    return spark.createDataFrame([(k, "d", "f.txt", 1, i, v) for i, (k, v) in enumerate(texts.items())], "chunk_id string, document_id string, filename string, page_number int, chunk_index int, text string")


LEX = {"generic": "Refund requests need standard approval.", "exact": "Approved refunds use the exact reference ORION-30.", "unrelated": "Commuter enrollment starts next month."}


def test_bm25_values(spark):
    q = spark.createDataFrame([("q", "ORION-30 approval reference")], "query_id string, text string")
    got = [(x.chunk_id, round(x.score, 6), x["rank"]) for x in r.bm25(q, chunks(spark, LEX), 3).orderBy("rank").collect()]
    assert got == [("exact", 0.967244, 1), ("generic", 0.525608, 2)]


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    docs = {f"c{i}": " ".join(rng.choice(["red", "blue", "green", "the", "x1", "x2", "x3"]) for _ in range(rng.randint(0, 12))) for i in range(40)}
    query = "red red x1 blue"
    toks = {k: [t for t in v.split() if t != "the"] for k, v in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {t: sum(t in v for v in toks.values()) for v in toks.values() for t in v}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    want = {k: sum(idf.get(t, 0) * v.count(t) * 2.5 / (v.count(t) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for t in query.split()) for k, v in toks.items() if set(v) & set(query.split())}
    order = sorted(want, key=lambda k: (-round(want[k], 10), k))[:10]
    q = spark.createDataFrame([("q", query)], "query_id string, text string")
    got = r.bm25(q, chunks(spark, docs), 10).orderBy("rank").collect()
    assert [x.chunk_id for x in got] == order and all(abs(x.score - want[x.chunk_id]) < 1e-9 for x in got)
    stats = r.corpus_stats(chunks(spark, docs)).head()
    assert (stats.n, stats.vocabulary) == (n, len(df)) and abs(stats.mean_idf - mean) < 1e-9


def test_fusion_order(spark):
    v = spark.createDataFrame([("q", "vector_only", 1), ("q", "shared", 2)], "query_id string, chunk_id string, rank int")
    x = spark.createDataFrame([("q", "lexical_only", 1), ("q", "shared", 2)], "query_id string, chunk_id string, rank int")
    got = [(c.chunk_id, c.vector_rank, c.lexical_rank, round(c.rrf_score, 6)) for c in r.rrf(v, x).orderBy("rank").collect()]
    assert got == [("shared", 2, 2, round(2 / 62, 6)), ("lexical_only", None, 1, round(1 / 61, 6)), ("vector_only", 1, None, round(1 / 61, 6))]
    with pytest.raises(ValueError):
        r.rrf(v, x, 0)


def test_rerank_prefers_identifiers(spark):
    q = spark.createDataFrame([("q", "refund approval reference ORION-30")], "query_id string, text string")
    c = spark.createDataFrame([("q", "generic", 0.04, "Refund approval policies and standard forms."), ("q", "exact", 0.02, "Use reference ORION-30 for approved refunds.")], "query_id string, chunk_id string, rrf_score double, text string")
    assert [(x.chunk_id, round(x.score, 3)) for x in r.rerank(q, c, 5).orderBy("rank").collect()] == [("exact", 0.525), ("generic", 0.375)]


@pytest.mark.parametrize("parts", [1, 5])
def test_neighbours_against_brute_force(spark, parts):
    rng = np.random.default_rng(2)
    v = {f"v{i:02}": rng.normal(size=8).round(1).tolist() for i in range(60)} | {"zero": [0.0] * 8, "short": [1.0, 2.0], "none": [], "v99": None}
    v["v60"] = v["v00"]
    q = {"a": v["v00"], "b": [1.0] * 8, "z": [0.0] * 8}

    def distance(x, y):
        x, y = x or [], y or []
        if len(x) != len(y) or not x:
            return 2.0
        nx, ny = np.linalg.norm(x), np.linalg.norm(y)
        return 1.0 if nx * ny == 0 else max(0.0, 1 - float(np.dot(x, y)) / (nx * ny))

    qs = spark.createDataFrame(list(q.items()), "query_id string, embedding array<double>")
    vs = spark.createDataFrame([(k, "o1" if k < "v30" else "o2", e) for k, e in v.items()], "vector_id string, owner_id string, embedding array<double>").repartition(parts)
    for owners in (None, ["o1"], []):
        got = r.knn(qs, vs, 7, owners, block=16).collect()
        for k, e in q.items():
            held = [n for n in v if owners is None or ("o1" if n < "v30" else "o2") in owners]
            want = sorted((round(distance(e, v[n]), 9), n) for n in held)[:7]
            assert sorted((round(x.distance, 9), x.vector_id) for x in got if x.query_id == k) == want


def test_approximate_neighbours_are_exactly_scored(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10))
    rows = [(f"v{i}", (centres[i % 12] + 0.3 * rng.normal(size=10)).tolist()) for i in range(600)]
    odd = [("zero", [0.0] * 10), ("short", [1.0]), ("none", []), ("null", None), ("nan", [float("nan")] * 10)]
    vs = spark.createDataFrame(rows + odd, "vector_id string, embedding array<double>").repartition(3)
    qs = spark.createDataFrame(rows[::60] + [("z", [0.0] * 10), ("s", [2.0]), ("far", (-centres.sum(0)).tolist())], "query_id string, embedding array<double>")
    index = n.build_index(vs, 5, parts=5)
    assert index.packets.agg(F.sum("n")).first()[0] == 600  # every row with a direction is indexed
    table = lambda df: {(x.query_id, x.vector_id): x.distance for x in df.collect()}
    exact, near = table(r.knn(qs, vs, 5)), table(n.search(index, qs, vs, 5))
    met = exact.keys() & near.keys()
    assert len(near) == len(exact) and len(met) >= 0.9 * len(exact) and all(abs(exact[k] - near[k]) < 1e-9 for k in met)
    assert {k: v for k, v in near.items() if k[0] in "zs"} == {k: v for k, v in exact.items() if k[0] in "zs"}
    costs = n.work(index, qs).collect()
    assert len(costs) == 11 and all(x.scored < 0.1 * 600 and x.estimated < 0.5 * 600 for x in costs)


def test_queries_meet_the_lists_in_bounded_rounds(spark, monkeypatch):
    """What is broadcast grows with the queries, not with their lists, and no pair is joined with its vectors."""
    rng = np.random.default_rng(4)
    vs = spark.createDataFrame([(f"v{i}", rng.normal(size=16).tolist()) for i in range(900)], "vector_id string, embedding array<double>").repartition(3)
    qs = vs.where("int(substr(vector_id, 2)) % 10 = 0").withColumnRenamed("vector_id", "query_id")
    index = n.build_index(vs, 5)
    assert index.probes > 5
    rounds, found = [], []
    monkeypatch.setattr(n, "in_rounds", lambda *a: (rounds.append(staging.in_rounds(*a)), rounds[-1])[1])
    for limit in (20_000, 1_500):  # 90 queries of 128 bytes and a name
        monkeypatch.setattr(staging, "ROUND_BYTES", limit)
        near = n.search(index, qs, vs, 5)
        assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
        found.append(sorted(tuple(x) for x in near.select("query_id", "rank", "vector_id", "distance").collect()))
    assert rounds[0][1] == 1 < rounds[1][1] and found[0] == found[1] and len(found[0]) == 450


def test_texts_by_counts_are_the_neighbours_of_their_vectors(spark, monkeypatch):
    from lodestrata.operators import counted

    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    some = {f"t{i}": " ".join(rng.choices(words, k=rng.choice((1, 2, 5, 12, 40)))) for i in range(700)}
    some |= {"empty": "", "null": None, "stop": "the of", "same1": "w1 w2", "same2": "w2 w1", "often": "w3 " * 9 + "w4", "long": "w5 " * 300 + "w6 w7", "longer": "w8 " * 70_000 + "w9", "twice": "w1 w2 w1 w2"}
    texts = spark.createDataFrame(list(some.items()), "vector_id string, text string").repartition(5)
    asked = texts.where("substr(vector_id, -1) in ('3', '7') or vector_id not like 't%'").withColumnRenamed("vector_id", "query_id")
    vectors = r.embed_hashed(texts, "text")
    exact = r.knn(r.embed_hashed(asked, "text"), vectors, 5)
    rows = lambda df: sorted((x.query_id, x["rank"], x.vector_id, round(x.distance, 10)) for x in df.collect())
    found, rounds = counted.knn_hashed(asked, texts, 5), []
    assert rows(found) == rows(exact) and exact.count() == 5 * asked.count()
    # in blocks of 16 queries, few texts and several rounds; pairs under the floor are no matches
    monkeypatch.setattr(counted, "CELLS", 16 * 256)
    monkeypatch.setattr(counted, "FIRST", 8)
    monkeypatch.setattr(counted, "CHUNK", 32)
    monkeypatch.setattr(staging, "ROUND_BYTES", 8_000)
    monkeypatch.setattr(counted, "in_rounds", lambda *x: (rounds.append(staging.in_rounds(*x)), rounds[-1])[1])
    strong = counted.knn_hashed(asked, texts, 5, floor=0.5)
    assert rows(strong.where("distance <= 0.5")) == rows(exact.where("distance <= 0.5"))
    assert 1 < rounds[0][1] < asked.count() * 2048 / 8_000 / 4  # a query is a few slots, not 2048 bytes


def test_the_best_of_rows_whatever_comes_first():
    rng = np.random.default_rng(5)
    rows, distances, names = rng.integers(0, 7, 4000), rng.integers(0, 40, 4000) / 8, rng.permutation(4000)
    best = r.Best(9, 6)
    best.most = 50
    for i in range(0, 4000, 37):
        best.take(rows[i : i + 37], distances[i : i + 37], names[i : i + 37])
    got = [x for part in best.found(5) for x in zip(*(c.tolist() for c in part), strict=True)]
    assert got == [x for q in range(7) for x in sorted((q, d, v) for a, d, v in zip(rows.tolist(), distances.tolist(), names.tolist(), strict=True) if a == q)[:6]]
    assert not list(r.Best(3, 2).found(5))


def test_an_index_of_nothing_and_of_one_row(spark):
    none = spark.createDataFrame([], "vector_id string, embedding array<double>")
    one = spark.createDataFrame([("a", [1.0, 0.0])], "vector_id string, embedding array<double>")
    qs = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, embedding array<double>")
    assert n.knn_approx(qs, none, 3).count() == 0 and n.knn_approx(qs.where("false"), one, 3).count() == 0
    assert [(x.vector_id, round(x.distance, 6), x["rank"]) for x in n.knn_approx(qs, one, 3).collect()] == [("a", 0.292893, 1)]


def test_codes_keep_what_they_stand_for():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 7))
    q = n.fit(points, 4, 3, 0)
    lists = q.assign(points)
    codes = q.encode(points, lists)
    for which in range(4):
        own = lists == which
        exact = ((points[:5, None, :] - points[own][None]) ** 2).sum(2)
        assert np.abs(q.estimates(points[:5], which, codes[own]) - exact).max() < 0.6 * exact.max()


def test_work_is_spread_without_broadcast_joins(spark):
    """Blocks of vectors are searched where they lie, also with broadcasts and adaptive execution off and few queries."""
    rng = np.random.default_rng(6)
    vs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(8000)], "vector_id long, embedding array<double>").repartition(8)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = r.knn(vs.limit(20).select(F.col("vector_id").alias("query_id"), "embedding"), vs, 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and found.count() == 60
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_staged_tables_can_be_removed(spark, tmp_path):
    kept = staging.staged(spark.range(3).toDF("id"), "kept")
    paths = [f.removeprefix("file://").rsplit("/", 1)[0] for f in kept.inputFiles()]
    assert kept.count() == 3 and os.path.isdir(paths[0])
    assert staging.remove_staged(spark) >= 1 and not os.path.exists(paths[0]) and staging.remove_staged(spark) == 0


def test_queries_in_many_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(90)], "vector_id long, embedding array<double>")
    qs = vs.where("vector_id < 25").select(F.col("vector_id").alias("query_id"), "embedding")
    want = sorted(map(tuple, r.knn(qs, vs, 4, block=6).collect()))
    monkeypatch.setattr(staging, "ROUND_BYTES", 200)
    assert sorted(map(tuple, r.knn(qs, vs, 4, block=6).collect())) == want and len(want) == 100


def test_hashed_embeddings():
    a, b = r.hashed_embedder()(["Refund policy refund", "the of"])
    assert abs(np.linalg.norm(a) - 1) < 1e-12 and np.count_nonzero(a) == 2 and b[0] == 1 and b.sum() == 1


def test_embedders_must_return_a_vector_each(spark):
    with pytest.raises(Exception):
        r.embed(spark.createDataFrame([("a",)], "t string"), "t", lambda texts: []).collect()


def test_context_keeps_sound_rows_once(spark):
    c = spark.createDataFrame([("q", 1, "a", "d", "f", 1), ("q", 2, "a", "d", "f", 1), ("q", 3, "b", "d", "", 1), ("q", 4, "c", "d", "f", 0), ("q", 5, "e", "d", "f", 2)], "query_id string, rank int, chunk_id string, document_id string, filename string, page_number int")
    assert [(x.chunk_id, x["rank"]) for x in r.select_context(c, 5).orderBy("rank").collect()] == [("a", 1), ("e", 2)]


PAGES = {"p1": "Travel policy. Flights are booked by the travel desk two weeks before departure.", "p2": "Refund policy. Refunds are accepted within 30 calendar days with the original receipt ORION-30.", "p3": "Remote work. Employees may work remotely three days a week after approval."}


@pytest.mark.parametrize("mode", ["hybrid", "vector_only"])
def test_search_finds_labelled_chunks(spark, mode):
    qs = spark.createDataFrame([("1", "Please find the refund policy window in my documents."), ("2", "remote work three days a week"), ("3", "are flights booked by the travel desk")], "query_id string, text string")
    c = chunks(spark, PAGES)
    found = r.hybrid_search(qs, c, mode)
    cases = spark.createDataFrame([("1", "f.txt", 1, 1), ("2", "f.txt", 1, 2), ("3", "f.txt", 1, 0)], "query_id string, relevant_document string, relevant_page int, relevant_chunk_index int")
    m = ev.retrieval_metrics(ev.label_results(found.select("query_id", "chunk_id", "rank"), c, cases).withColumn("mode", F.lit(mode)), cases, 3).head()
    assert (m.recall_at_k, m.mrr, m.cases) == (1.0, 1.0, 3)


def test_metrics_count_queries_without_hits(spark):
    res = spark.createDataFrame([("h", "1", 2, True), ("h", "2", 1, False)], "mode string, query_id string, rank int, relevant boolean")
    m = ev.retrieval_metrics(res, spark.createDataFrame([("1",), ("2",), ("3",)], "query_id string"), 3).head()
    assert (round(m.recall_at_k, 4), round(m.mrr, 4), m.cases) == (0.3333, 0.1667, 3)
    both = ev.retrieval_metrics(res, spark.createDataFrame([("1",), ("2",)], "query_id string"), 3, ["h", "none"]).collect()
    assert {x["mode"]: (x.recall_at_k, x.cases) for x in both} == {"h": (0.5, 2), "none": (0.0, 2)}


def test_owner_filter_of_nothing(spark):
    assert r.filter_owners(chunks(spark, PAGES), []).count() == 0 and r.filter_owners(chunks(spark, PAGES), None).count() == 3


def test_debug_lists_all_stages(spark):
    qs = spark.createDataFrame([("1", "refund receipt")], "query_id string, text string")
    final, debug = r.hybrid_search(qs, chunks(spark, PAGES), debug=True)
    assert {x.stage for x in debug.collect()} == {"vector", "lexical", "fused", "reranked", "final"}
    assert [x.citation_id for x in r.build_citations(final).collect()][0] == "citation_p2"


def test_nearest_of_queries_in_any_order_and_partitions(spark):
    rng = np.random.default_rng(4)
    vectors = [(f"v{i}", rng.normal(size=4).tolist()) for i in range(150)] + [("zero", [0.0] * 4), ("short", [1.0])]
    queries = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    held = spark.createDataFrame(vectors, "vector_id string, embedding array<double>")
    want = None
    for order, parts in ((1, 1), (-1, 7), (1, 3)):
        asked = spark.createDataFrame(queries[::order], "query_id long, embedding array<double>").repartition(parts)
        got = sorted((x.query_id, x["rank"], x.vector_id) for x in r.knn(asked, held, 5, block=8).collect())
        want = want or got
        assert got == want and len(got) == 300
    for i, q in queries[:10]:
        near = sorted((max(0.0, 1 - np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)) if len(v) == 4 and any(v) else 1.0 if len(v) == 4 else 2.0, n) for n, v in vectors)[:5]
        assert [v for q_id, _, v in want if q_id == str(i)] == [n for _, n in near]


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_approximate_neighbours_are_found(spark, scale):
    from lodestrata.plans.registry import QUERIES

    found = QUERIES["knn_approx_recall"](spark, f"/root/testdata/{scale}").collect()
    assert sum(x.recall for x in found) >= 0.9 * len(found) > 0
    assert sum(x.scored_share for x in found) < 0.1 * len(found)


def test_a_labels_first_rows_are_ranked_once(spark, monkeypatch):
    from lodestrata.plans import search

    met, ranked = [], r.rank_candidates
    monkeypatch.setattr(r, "rank_candidates", lambda df, order, k=None: (met.append(df) if "c" in df.columns else None, ranked(df, order, k))[1])
    search.rrf_fused(spark, "/root/testdata/sf0.01")
    assert [df.count() for df in met] == [20 * search.vector_tables(spark, "/root/testdata/sf0.01")[0].count()]


def test_vectors_meet_queries_without_a_join(spark):
    e = spark.createDataFrame([(str(i), [float(i % 7), 1.0] if i % 5 else [1.0] * (i % 3) if i % 10 else None) for i in range(300)], "id string, embedding array<double>")
    found = r.knn(e.where("id < 3").withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "vector_id"), 4, block=7)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    rows = {x.id: x.embedding or [] for x in e.collect()}

    def distance(a, b):
        if len(a) != len(b) or not a:
            return 2.0
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(max(0.0, 1 - np.dot(a, b) / size), 12) if size else 1.0

    want = {(q, n, v) for q in rows if int(q) < 3 for n, (_, v) in enumerate(sorted((distance(rows[q], rows[v]), v) for v in rows)[:4], 1)}
    assert {(x.query_id, x["rank"], x.vector_id) for x in found.collect()} == want


def test_texts_are_embedded_some_at_a_time(spark):
    def embedder(texts):
        assert len(texts) <= 1000
        return [[1.0]] * len(texts)

    assert r.embed(spark.range(2500).selectExpr("string(id) AS t").coalesce(1), "t", embedder).count() == 2500
