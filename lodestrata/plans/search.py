"""Queries of texts, chunks, retrieval and media."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import corpus, evaluate, media, neighbours, retrieval
from lodestrata.plans.common import query, rounded, spread, table
from lodestrata.sources.tables import pages_from_text

STOP = ", ".join(f"'{w}'" for w in tx.QUERY_STOP_WORDS)
#: Case folding as far as the documents' alphabets need it.
FOLDED = "replace(lower(text), 'ß', 'ss')"
ALL = f"regexp_extract_all({FOLDED}, '[a-z0-9]+(?:[-_.][a-z0-9]+)*')"
TOKENS = f"list_filter({ALL}, lambda t: t NOT IN ({STOP}))"


def documents(spark, d):
    return spread(table(spark, d, "documents"))


def chunks_of(spark, d):
    """Each document as one chunk."""
    docs = documents(spark, d).where("text is not null")
    key = F.col("doc_id").cast("string")
    return docs.select(key.alias("chunk_id"), key.alias("document_id"), F.concat(F.lit("doc-"), key, F.lit(".txt")).alias("filename"), F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index"), "text")


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n_tokens, sha256(array_to_string({TOKENS}, ' ')) AS tokens_sha256 FROM documents")
def tokenize_docs(spark, d):
    tokens = documents(spark, d).select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), tx.sha256(F.array_join("t", " ")).alias("tokens_sha256"))


@query(f"SELECT doc_id, sha256(array_to_string({ALL}, ' ')) AS phrase_sha256 FROM documents")
def normalized_phrases(spark, d):
    return documents(spark, d).select("doc_id", tx.sha256(tx.normalized_phrase(F.col("text"))).alias("phrase_sha256"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[''’-][\p{L}\p{M}\p{N}_]+)*|[^\p{L}\p{M}\p{N}_\s]')) AS INTEGER) AS token_estimate FROM documents")
def token_counts(spark, d):
    return documents(spark, d).select("doc_id", tx.estimate_tokens(F.col("text")).alias("token_estimate"))


WRAP = "'  Please find  ' || text || ' in my documents. '"


@query(rf"""WITH f AS (SELECT conv_id, turn, trim(regexp_replace({WRAP}, '\s+', ' ', 'g')) AS flat FROM conversations WHERE role = 'user'),
b AS (SELECT *, trim(regexp_replace(regexp_replace(flat, '(?i)^(?:please\s+)?(?:find|locate|look\s+up|search\s+for|show\s+me|tell\s+me)\s+', ''), '(?i)\s+(?:in|from)\s+(?:(?:my|the|uploaded)\s+)?(?:documents?|pdfs?|files?)\.?$', ''), ' .?!') AS bare FROM f)
SELECT conv_id, turn, replace(lower(CASE WHEN bare = '' THEN flat ELSE bare END), 'ß', 'ss') AS normalized FROM b""")
def normalize_queries(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", tx.normalize_query(F.concat(F.lit("  Please find  "), "text", F.lit(" in my documents. "))).alias("normalized"))


TERMS = "['', ' compare the sales', ' which video scene', ' see the report']"


@query(rf"""WITH q AS (SELECT conv_id, turn, lower(text || {TERMS}[CAST(turn % 4 AS INTEGER) + 1]) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\b({"|".join(tx.ANALYTICS_TERMS)})\b') THEN 'data_analytics' WHEN regexp_matches(t, '\b({"|".join(tx.VIDEO_TERMS)})\b') THEN 'video_search'
  WHEN regexp_matches(t, '\b({"|".join(tx.DOCUMENT_TERMS)})\b') THEN 'document_search' ELSE 'direct_answer' END AS route FROM q""")
def route_queries(spark, d):
    more = F.array(*map(F.lit, ["", " compare the sales", " which video scene", " see the report"]))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.get(more, (F.col("turn") % 4).cast("int"))).alias("text"))
    return tx.route_queries(turns, "text").drop("text")


EMBEDDING_STOP = ", ".join(f"'{w}'" for w in retrieval.EMBEDDING_STOP_WORDS)


@query(rf"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all({FOLDED}, '[\p{{L}}\p{{N}}_]+'), lambda t: t NOT IN ({EMBEDDING_STOP}))) AS token FROM documents),
s AS (SELECT doc_id, ('0x' || substr(sha256(token), 1, 4))::BIGINT % 256 AS slot, count(*) AS c FROM t GROUP BY ALL),
v AS (SELECT doc_id, string_agg(slot || ':' || CAST(floor(c / sqrt(n) * 1000000 + 0.500001) AS BIGINT), ',' ORDER BY slot) AS slots FROM (SELECT *, sum(c * c) OVER (PARTITION BY doc_id) AS n FROM s) GROUP BY 1)
SELECT doc_id, 256 AS dim, coalesce(slots, '0:1000000') AS slots FROM documents LEFT JOIN v USING (doc_id)""")
def hashed_embeddings(spark, d):
    """Each document's vector as slot:value in millionths, where it is not 0."""
    found = retrieval.embed_hashed(documents(spark, d).select("doc_id", "text"), "text")
    slot = lambda x, i: F.when(x > 0, F.concat_ws(":", i, F.floor(x * 1000000 + 0.500001)))
    return found.select("doc_id", F.size("embedding").alias("dim"), F.array_join(F.transform("embedding", slot), ",").alias("slots"))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS vector_id, greatest(0, 1 - list_cosine_similarity(q.e, CAST(embedding AS DOUBLE[]))) AS distance FROM q, embeddings),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, CAST(vector_id AS VARCHAR)) AS INTEGER) AS rank FROM s)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(vector_id AS VARCHAR) AS vector_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 20""")
def knn_exact(spark, d):
    return rounded(retrieval.knn(*vector_tables(spark, d), 20), "distance", places=6)


def vector_tables(spark, d):
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("vector_id"), F.col("label").alias("owner_id"), "embedding")


@query()
def knn_approx_recall(spark, d):
    """Of every query: the share of the exact neighbours that the approximate search finds, and the shares of all vectors that it estimates and scores."""
    queries, vectors = vector_tables(spark, d)
    index = neighbours.build_index(vectors, 10)
    found = neighbours.meet(index, queries, 10)
    exact, near = retrieval.knn(queries, vectors, 10), neighbours.search(index, queries, vectors, 10, found)
    met = exact.select("query_id", "vector_id").join(near.select("query_id", "vector_id", F.lit(1).alias("found")), ["query_id", "vector_id"], "left")
    recall = met.groupBy("query_id").agg(F.round(F.count("found") / F.count("*"), 4).alias("recall"))
    share = lambda c: F.round(F.col(c) / F.col("n"), 4).alias(f"{c}_share")
    every = recall.join(neighbours.work(index, queries, found), "query_id").crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n"))))
    return every.select("query_id", "recall", share("estimated"), share("scored"))


STATS = f"""t AS (SELECT doc_id, {TOKENS} AS tokens FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS token FROM t),
tf AS (SELECT doc_id, length, token, count(*) AS tf FROM p GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_length FROM t),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), i AS (SELECT token, n, avg_length, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, n), m AS (SELECT avg(idf) AS mean_idf FROM i)"""
LEXICAL = f"""{STATS}, q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest({TOKENS}) AS token FROM benchmark), qt AS (SELECT query_id, token, count(*) AS times FROM q GROUP BY ALL),
sc AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, sum(times * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))) AS score
  FROM qt JOIN i USING (token) JOIN tf USING (token), m GROUP BY ALL),
lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM sc)"""


@query(f"WITH {STATS} SELECT n, round(avg_length, 4) AS avg_length, (SELECT count(*) FROM i) AS vocabulary, (SELECT round(mean_idf, 6) FROM m) AS mean_idf FROM n")
def corpus_stats(spark, d):
    return rounded(rounded(retrieval.corpus_stats(chunks_of(spark, d)), "avg_length"), "mean_idf", places=6)


def lexical(spark, d, k):
    return retrieval.bm25(asked(spark, d), chunks_of(spark, d), k)


@query(f"WITH {LEXICAL} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM lex WHERE rank <= 20")
def bm25_topk(spark, d):
    return rounded(lexical(spark, d, 20), "score", places=5)


RRF_LISTS = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.e, v.e) AS c, q.label = v.label AS same FROM e q, e v WHERE q.vec_id % 50 = 0),
v AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, CAST(chunk_id AS VARCHAR)) AS rank FROM s), l AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM s WHERE same),
u AS (SELECT query_id, chunk_id, rank AS vector_rank, NULL::BIGINT AS lexical_rank FROM v WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, NULL, rank FROM l WHERE rank <= 20),
f AS (SELECT query_id, chunk_id, min(vector_rank) AS vector_rank, min(lexical_rank) AS lexical_rank FROM u GROUP BY ALL),
g AS (SELECT *, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS rrf FROM f)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(chunk_id AS VARCHAR) AS chunk_id, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank, round(rrf, 8) AS rrf_score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, least(vector_rank, lexical_rank), CAST(chunk_id AS VARCHAR)) AS INTEGER) AS rank FROM g"""


@query(RRF_LISTS)
def rrf_fused(spark, d):
    queries, vectors = vector_tables(spark, d)
    near = retrieval.knn(queries, vectors, 20).select("query_id", F.col("vector_id").alias("chunk_id"), "rank")
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    # the order does not depend on the query: a label's first rows are those of each of its queries
    first = labels.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("vec_id"))).where("n <= 20").select("label", F.col("vec_id").alias("c"))
    same = labels.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "label").join(first, "label")
    by_label = retrieval.rank_candidates(same, [F.col("c")], 20).select("query_id", F.col("c").cast("string").alias("chunk_id"), "rank")
    return rounded(retrieval.rrf(near, by_label), "rrf_score", places=8)


@query(f"""WITH {LEXICAL}, c AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS rrf FROM lex WHERE rank <= 20),
b AS (SELECT CAST(item_id AS VARCHAR) AS query_id, list_distinct({TOKENS}) AS q, array_to_string({ALL}, ' ') AS phrase FROM benchmark), dd AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, list_distinct({TOKENS}) AS d, array_to_string({ALL}, ' ') AS phrase FROM documents),
x AS (SELECT c.query_id, c.chunk_id, rrf, CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0 END AS coverage, list_filter(q, lambda t: regexp_matches(t, '[0-9]')) AS ids, d, b.phrase <> '' AND contains(dd.phrase, b.phrase) AS exact FROM c JOIN b USING (query_id) JOIN dd USING (chunk_id)),
y AS (SELECT *, least(1.0, 0.55 * coverage + 0.2 * CASE WHEN len(ids) > 0 THEN len(list_intersect(ids, d)) / len(ids) ELSE coverage END + 0.15 * CAST(exact AS DOUBLE) + 0.1 * rrf / max(rrf) OVER (PARTITION BY query_id)) AS score FROM x),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rrf DESC, chunk_id) AS INTEGER) AS rank FROM y)
SELECT query_id, chunk_id, round(score, 6) AS score, round(coverage, 6) AS query_coverage, exact AS exact_phrase, rank FROM z WHERE rank <= 10""")
def rerank(spark, d):
    fused = lexical(spark, d, 20).select("query_id", "chunk_id", (1.0 / (60 + F.col("rank"))).alias("rrf_score")).join(chunks_of(spark, d).select("chunk_id", "text"), "chunk_id")
    return rounded(retrieval.rerank(asked(spark, d), fused), "score", "query_coverage", places=6).select("query_id", "chunk_id", "score", "query_coverage", "exact_phrase", "rank")


def normal(text: str) -> str:
    """A question without its request and source phrases, folded."""
    flat = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    bare = rf"trim(regexp_replace(regexp_replace({flat}, '(?i)^(?:please\s+)?(?:find|locate|look\s+up|search\s+for|show\s+me|tell\s+me)\s+', ''), '(?i)\s+(?:in|from)\s+(?:(?:my|the|uploaded)\s+)?(?:documents?|pdfs?|files?)\.?$', ''), ' .?!')"
    return f"replace(lower(CASE WHEN {bare} = '' THEN {flat} ELSE {bare} END), 'ß', 'ss')"


def vectors_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE `name`: key, slot, c and the norm of each text's hashed vector; slot 0 where it has no token."""
    words = rf"list_filter(regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+'), lambda t: t NOT IN ({EMBEDDING_STOP}))"
    return f"""{name}_t AS (SELECT {key}, unnest(CASE WHEN len(w) > 0 THEN list_transform(w, lambda t: ('0x' || substr(sha256(t), 1, 4))::BIGINT % 256) ELSE [0] END) AS slot FROM (SELECT {key}, coalesce({words}, []) AS w FROM {source})),
{name} AS (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY {key})) AS norm FROM (SELECT {key}, slot, count(*) AS c FROM {name}_t GROUP BY ALL))"""


#: Distances of hashed vectors to the 12th place, which sums in any order agree on.
DISTANCE = "round(greatest(0, 1 - sum(a.c * b.c) / (a.norm * b.norm)), 12)"
NEAR = f"""nq AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS passage, {normal("text")} AS text FROM benchmark), nd AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text AS body FROM documents WHERE text IS NOT NULL),
{vectors_sql("vq", "nq", "query_id", "text")}, {vectors_sql("vd", "nd", "chunk_id", "body")},
di AS (SELECT query_id, chunk_id, {DISTANCE} AS distance FROM vq a JOIN vd b USING (slot) GROUP BY query_id, chunk_id, a.norm, b.norm),
vec AS (SELECT query_id, chunk_id, 1 - distance AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM di QUALIFY rank <= 20 AND score >= 0.25)"""
#: Both lists, fused, reranked and cut to the contexts, as stages of one table.
HYBRID = f"""{NEAR}, {LEXICAL.replace("FROM benchmark", "FROM nq").replace("CAST(item_id AS VARCHAR) AS query_id", "query_id")},
fu AS (SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS rrf, least(v.rank, l.rank) AS best FROM vec v FULL JOIN (FROM lex WHERE rank <= 20) l USING (query_id, chunk_id)),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best, chunk_id) AS INTEGER) AS rank FROM fu),
bq AS (SELECT query_id, list_distinct({TOKENS}) AS q, array_to_string({ALL}, ' ') AS phrase FROM nq), bd AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, list_distinct({TOKENS}) AS d, array_to_string({ALL}, ' ') AS phrase FROM documents),
rx AS (SELECT query_id, chunk_id, rrf, CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0 END AS coverage, list_filter(q, lambda t: regexp_matches(t, '[0-9]')) AS ids, d, bq.phrase <> '' AND contains(bd.phrase, bq.phrase) AS exact FROM fused JOIN bq USING (query_id) JOIN bd USING (chunk_id)),
ry AS (SELECT *, least(1.0, 0.55 * coverage + 0.2 * CASE WHEN len(ids) > 0 THEN len(list_intersect(ids, d)) / len(ids) ELSE coverage END + 0.15 * CAST(exact AS DOUBLE) + 0.1 * rrf / max(rrf) OVER (PARTITION BY query_id)) AS score FROM rx),
rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rrf DESC, chunk_id) AS INTEGER) AS rank FROM ry QUALIFY rank <= 10)"""


@query(f"WITH {HYBRID} SELECT query_id, rank, chunk_id, 'doc-' || chunk_id || '.txt' AS filename, 1 AS page_number, round(score, 6) AS score, round(rrf, 6) AS rrf_score, round(coverage, 6) AS query_coverage, exact AS exact_phrase FROM rr WHERE rank <= 5")
def hybrid_search(spark, d):
    """W2: every benchmark passage over all documents."""
    found = retrieval.hybrid_search(asked(spark, d), chunks_of(spark, d))
    return rounded(found, "score", "rrf_score", "query_coverage", places=6).select("query_id", "rank", "chunk_id", "filename", "page_number", "score", "rrf_score", "query_coverage", "exact_phrase")


@query(f"WITH {NEAR} SELECT query_id, rank, chunk_id, 'doc-' || chunk_id || '.txt' AS filename, 1 AS page_number, round(score, 6) AS score FROM vec WHERE rank <= 5")
def vector_only_search(spark, d):
    return rounded(retrieval.hybrid_search(asked(spark, d), chunks_of(spark, d), "vector_only"), "score", places=6).select("query_id", "rank", "chunk_id", "filename", "page_number", "score")


@query(f"""WITH {HYBRID} SELECT query_id, stage, rank, chunk_id, floor(score * 1000000 + 0.500001) / 1000000 AS score FROM (SELECT query_id, 'vector' AS stage, rank, chunk_id, score FROM vec UNION ALL SELECT query_id, 'lexical', rank, chunk_id, score FROM lex WHERE rank <= 20
UNION ALL SELECT query_id, 'fused', rank, chunk_id, rrf FROM fused UNION ALL SELECT query_id, 'reranked', rank, chunk_id, score FROM rr UNION ALL SELECT query_id, 'final', rank, chunk_id, score FROM rr WHERE rank <= 5)""")
def retrieval_debug(spark, d):
    found = retrieval.hybrid_search(asked(spark, d), chunks_of(spark, d), debug=True)[1]
    return found.withColumn("score", F.floor(F.col("score") * 1000000 + 0.500001) / 1000000)


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS q, v.vec_id AS v, q.label = v.label AS relevant, list_cosine_similarity(q.e, v.e) AS c FROM e q, e v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT q, relevant, row_number() OVER (PARTITION BY q ORDER BY greatest(0, 1 - c), CAST(v AS VARCHAR)) AS rank FROM s), f AS (SELECT q, min(rank) FILTER (relevant AND rank <= 20) AS first FROM r GROUP BY q)
SELECT 'vector' AS mode, round(avg(CASE WHEN first <= 3 THEN 1 ELSE 0 END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, count(*) AS cases FROM f""")
def retrieval_metrics(spark, d):
    queries, vectors = vector_tables(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    near = retrieval.rank_candidates(retrieval.knn(queries, vectors, 21).where("query_id != vector_id").drop("rank"), [F.col("distance"), F.col("vector_id")], 20)
    known = near.join(labels.toDF("query_id", "ql"), "query_id").join(labels.toDF("vector_id", "vl"), "vector_id")
    return evaluate.retrieval_metrics(known.select(F.lit("vector").alias("mode"), "query_id", "rank", (F.col("ql") == F.col("vl")).alias("relevant")), queries.select(F.col("query_id").cast("string").alias("query_id")), 3)


@query(f"""WITH {HYBRID}, fo AS (SELECT 'hybrid' AS mode, query_id, chunk_id, rank FROM rr WHERE rank <= 5 UNION ALL SELECT 'vector_only', query_id, chunk_id, rank FROM vec WHERE rank <= 5),
fi AS (SELECT mode, query_id, min(rank) AS first FROM fo JOIN nd USING (chunk_id) JOIN nq USING (query_id) WHERE contains(body, passage) GROUP BY ALL)
SELECT mode, round(avg(CASE WHEN first <= 3 THEN 1 ELSE 0 END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, count(*) AS cases FROM (FROM (SELECT DISTINCT mode FROM fo), (SELECT DISTINCT query_id FROM nq)) LEFT JOIN fi USING (mode, query_id) GROUP BY mode""")
def benchmark_retrieval_metrics(spark, d):
    """Recall and MRR of both modes; a document is relevant to a passage that it contains."""
    queries, chunks = asked(spark, d), chunks_of(spark, d)
    texts, passages = chunks.select("chunk_id", F.col("text").alias("body")), queries.select("query_id", F.col("text").alias("passage"))
    out = None
    for mode in ("hybrid", "vector_only"):
        found = retrieval.hybrid_search(queries, chunks, mode).select("query_id", "chunk_id", "rank")
        hits = found.join(texts, "chunk_id").join(passages, "query_id").select(F.lit(mode).alias("mode"), "query_id", "rank", F.contains("body", F.col("passage")).alias("relevant"))
        out = hits if out is None else out.unionByName(hits)
    return evaluate.retrieval_metrics(out, queries, 3)


# ---- pages and chunks ----

PAGES = """l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
g AS (SELECT doc_id, lines, unnest(range(0, greatest(CAST(ceil(len(lines) / 10) AS INTEGER), 1))) AS k FROM l), pg AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, k + 1 AS page_number, list_slice(lines, k * 10 + 1, k * 10 + 10) AS paragraphs FROM g)"""


@query(f"""WITH {PAGES}, e AS (SELECT document_id, page_number, unnest(list_distinct([paragraphs[1], paragraphs[-1]])) AS edge FROM pg WHERE len(paragraphs) > 0),
r AS (SELECT document_id, edge FROM e WHERE length(edge) <= 120 GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT document_id, list(edge) AS edges FROM r GROUP BY 1)
SELECT document_id, CAST(page_number AS INTEGER) AS page_number, CAST(len(list_filter(paragraphs, lambda p: NOT coalesce(list_contains(edges, p), false))) AS INTEGER) AS n_paragraphs FROM pg LEFT JOIN s USING (document_id)""")
def boilerplate_lines(spark, d):
    pages = pages_from_text(documents(spark, d), lines_per_page=10)
    return corpus.remove_boilerplate(pages).select("document_id", "page_number", F.size("paragraphs").alias("n_paragraphs"))


@query(rf"""WITH {PAGES} SELECT document_id, count(*) AS page_count, CAST(sum(length(regexp_replace(array_to_string(paragraphs, ' '), '[^\p{{L}}\p{{N}}]', '', 'g'))) AS BIGINT) AS extractable, extractable < 40 AS ocr_required FROM pg GROUP BY 1""")
def ocr_gate(spark, d):
    return corpus.ocr_gate(pages_from_text(documents(spark, d), lines_per_page=10))


@query()
def chunk_documents(spark, d):
    """W1: pages of ten lines to chunks, boilerplate removed."""
    pages = corpus.remove_boilerplate(pages_from_text(documents(spark, d), lines_per_page=10))
    return corpus.build_chunks(pages).drop("text")


@query()
def chunk_bounds(spark, d):
    """How many chunks each document has and what sizes, with its page count and OCR flag."""
    pages = pages_from_text(documents(spark, d), lines_per_page=10)
    chunks = corpus.build_chunks(pages)
    sizes = chunks.groupBy("document_id").agg(F.min("token_estimate").alias("least"), F.max("token_estimate").alias("most"))
    return corpus.document_rollup(pages, chunks).join(sizes, "document_id", "left")


# ---- media: a user's events as a recording, its spans between neighbours ----

MEDIA = """ev AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id, event_type, date_diff('second', min(ts) OVER (PARTITION BY user_id), ts) / 10000.0 AS s FROM events),
media AS (SELECT video_id, 'user-' || video_id || '.mp4' AS filename, CAST(floor(max(s)) + 1 AS DOUBLE) AS duration FROM ev GROUP BY 1),
sp AS (SELECT video_id, CAST(floor(s) AS DOUBLE) AS t0, CAST(floor(s) + 2 AS DOUBLE) AS t1, event_type || event_id AS text FROM ev),
st AS (SELECT video_id, filename, duration, unnest(range(0, CAST(greatest(1, least(6, ceil(duration / 30))) AS INTEGER))) AS idx FROM media),
sg AS (SELECT video_id, filename, idx, CAST(idx * 30 AS DOUBLE) AS s0, coalesce(lead(CAST(idx * 30 AS DOUBLE)) OVER (PARTITION BY video_id ORDER BY idx), duration) AS s1 FROM st),
jn AS (SELECT sg.*, coalesce((SELECT string_agg(text, ' ' ORDER BY t0, t1, text) FROM sp WHERE sp.video_id = sg.video_id AND t0 < s1 AND t1 > s0), '') AS transcript FROM sg)"""


def media_tables(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), "event_id", "event_type", "ts")
    first = F.min("ts").over(W.partitionBy("video_id"))
    e = e.withColumn("s", F.floor(F.floor((F.date_trunc("second", "ts").cast("long") - F.date_trunc("second", first).cast("long"))) / 10000.0).cast("double"))
    m = e.groupBy("video_id").agg((F.max("s") + 1).alias("duration_seconds")).withColumn("filename", F.concat(F.lit("user-"), "video_id", F.lit(".mp4")))
    spans = e.select("video_id", F.col("s").alias("start_seconds"), (F.col("s") + 2).alias("end_seconds"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    visuals = m.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("idx")).withColumn("description", F.when(F.col("idx") % 2 == 0, "Visual enrichment unavailable.").otherwise(F.concat(F.lit("frame "), F.col("idx").cast("string"))))
    return m, spans, visuals


@query(f"WITH {MEDIA} SELECT video_id, CAST(idx AS INTEGER) AS idx, s0 AS start_seconds, s1 AS end_seconds FROM sg")
def segment_bounds(spark, d):
    m, _, _ = media_tables(spark, d)
    return media.segment_bounds(media.representative_timestamps(m), m).select("video_id", "idx", "start_seconds", "end_seconds")


@query(f"WITH {MEDIA} SELECT video_id, s0 AS start_seconds, s1 AS end_seconds, transcript FROM jn")
def overlap_spans(spark, d):
    m, spans, _ = media_tables(spark, d)
    return media.overlap_spans(media.segment_bounds(media.representative_timestamps(m), m), spans).select("video_id", "start_seconds", "end_seconds", "transcript")


SEGMENTS = f"""{MEDIA}, vs AS (SELECT *, CASE WHEN idx % 2 = 0 THEN 'Visual enrichment unavailable.' ELSE 'frame ' || idx END AS visual, printf('%.3f', s0) AS a, printf('%.3f', s1) AS b FROM jn),
sgm AS (SELECT *, CASE WHEN idx % 2 = 0 AND transcript = '' THEN 'Video segment from ' || a || ' to ' || b || ' seconds; ' || visual ELSE trim(transcript || CASE WHEN idx % 2 = 0 THEN '' WHEN transcript = '' THEN visual ELSE ' ' || visual END) END AS combined_text,
  'segment_' || substr(sha256(video_id || ':' || a || ':' || b), 1, 24) AS segment_id FROM vs)"""


@query(f"WITH {SEGMENTS} SELECT video_id, segment_id, sha256(combined_text) AS text_sha256 FROM sgm")
def media_segments(spark, d):
    return media.build_segments(*media_tables(spark, d)).select("video_id", "segment_id", tx.sha256(F.col("combined_text")).alias("text_sha256"))


@query(f"WITH {SEGMENTS} SELECT 'citation_' || segment_id AS citation_id, filename || ', ' || a || 's–' || b || 's' AS locator FROM sgm")
def citations(spark, d):
    return retrieval.build_citations(media.build_segments(*media_tables(spark, d))).select("citation_id", "locator")


@query(f"WITH {SEGMENTS} SELECT video_id, count(*) AS segment_count, CASE WHEN bool_or(visual LIKE '%unavailable.') THEN 'partial' ELSE 'completed' END AS processing_status FROM sgm GROUP BY 1")
def media_rollup(spark, d):
    return media.media_rollup(media.build_segments(*media_tables(spark, d)))


@query(f"""WITH {SEGMENTS}, aq AS (SELECT CAST(user_id AS VARCHAR) AS query_id, string_agg(DISTINCT event_type || event_id, ' ') AS text FROM events GROUP BY 1),
{vectors_sql("vq", "aq", "query_id", "text")}, {vectors_sql("vd", "sgm", "segment_id", "combined_text")},
di AS (SELECT query_id, segment_id, {DISTANCE} AS distance FROM vq a JOIN vd b USING (slot) GROUP BY query_id, segment_id, a.norm, b.norm),
ne AS (SELECT *, 1 - distance AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, segment_id) AS INTEGER) AS rank FROM di QUALIFY rank <= 5 AND score >= 0.1)
SELECT query_id, rank, segment_id, video_id, s0 AS start_seconds, s1 AS end_seconds, round(score, 6) AS score FROM ne JOIN sgm USING (segment_id)""")
def search_segments(spark, d):
    """Every user's event types asked of all segments."""
    types = table(spark, d, "events").groupBy("user_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set(F.concat("event_type", F.col("event_id").cast("string"))))).alias("text"))
    found = media.search_segments(types.select(F.col("user_id").cast("string").alias("query_id"), "text"), media.build_segments(*media_tables(spark, d)))
    return rounded(found, "score", places=6).select("query_id", "rank", "segment_id", "video_id", "start_seconds", "end_seconds", "score")


# ---- scalars ----


@query(r"""WITH b AS (SELECT page_id, trim(regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1)) AS name FROM pages)
SELECT page_id, CASE WHEN name NOT IN ('', '.', '..') AND length(name) <= 255 AND NOT regexp_matches(name, '[\p{Cc}\p{Cf}]') THEN name END AS filename FROM b""")
def safe_filenames(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_filename(F.col("url")).alias("filename"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(text, chr(173), ''), chr(160), ' '), '([\p{L}\p{N}_])-[ \t]*\n[ \t]*([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g'))) AS block_sha256 FROM documents""")
def normalize_blocks(spark, d):
    return documents(spark, d).select("doc_id", tx.sha256(tx.normalize_block(F.col("text"))).alias("block_sha256"))
