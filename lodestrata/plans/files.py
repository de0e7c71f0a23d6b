"""Queries of what is written and read again: datasets, cases, records, summaries, event logs, ingested streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import analytics, corpus, evaluate, retrieval
from lodestrata.plans.common import query, spread, table
from lodestrata.plans.search import ALL, vector_tables
from lodestrata.sources import store
from lodestrata.sources import tables as src
from lodestrata.sources.files import admit_files, write_files
from lodestrata.sources.keyed import KeyedStore
from lodestrata.sources.staging import new_path
from lodestrata.streaming import events as ev
from lodestrata.streaming.state import ingest_stream


@query("""SELECT CAST(c_custkey AS VARCHAR) AS custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment, 'of "' || lower(c_mktsegment) || '", so' AS note FROM customer""")
def csv_dataset(spark, d):
    """Customers as strict CSV files, with blanks, quotes and commas, read back as text."""
    path = new_path(spark, "dataset")
    segment = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).otherwise("  ")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), segment.alias("segment"), F.concat(F.lit('of "'), F.lower("c_mktsegment"), F.lit('", so')).alias("note"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return src.read_csv_dataset(spark, path)


@query("""SELECT '1' AS schema_version, 'part-' || (turn % 4) AS dataset_id, conv_id || ':' || turn AS case_id, text AS query, CASE WHEN turn % 2 = 0 THEN 'document_search' ELSE 'direct_answer' END AS expected_route, role AS expected_tool FROM conversations""")
def evaluation_cases(spark, d):
    """Turns as routing cases in files of one document each, several to a dataset."""
    path = new_path(spark, "cases")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    case = F.struct(key.alias("case_id"), F.col("text").alias("query"), F.when(F.col("turn") % 2 == 0, "document_search").otherwise("direct_answer").alias("expected_route"), F.col("role").alias("expected_tool"))
    files = table(spark, d, "conversations").groupBy(F.concat(F.lit("part-"), (F.col("turn") % 4).cast("string")).alias("dataset_id"), F.floor(F.col("conv_id") / 50).alias("part")).agg(F.collect_list(case).alias("routing_cases"))
    files.select(F.lit("1").alias("schema_version"), "dataset_id", "routing_cases").write.option("maxRecordsPerFile", 1).json(path)
    return src.read_eval_cases(spark, path, "routing_cases")


@query("SELECT doc_id AS record_id, source, n_chars FROM documents")
def stored_records(spark, d):
    """Documents stored in two commits, and read by kind."""
    path = new_path(spark, "records")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "source", "n_chars")
    for odd in (0, 1):
        store.write_records(docs.where(F.pmod("record_id", F.lit(2)) == odd), path, "document")
    return store.read_records(spark, path, "document").select("record_id", "source", "n_chars")


@query("SELECT event_type AS run_id, max(ts) AS created_at, count(*) AS cases FROM events GROUP BY 1 ORDER BY created_at DESC, run_id DESC LIMIT 3")
def recent_summaries(spark, d):
    """A summary of each type of event, appended in two commits; the three newest."""
    path = new_path(spark, "summaries")
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("run_id")).agg(F.max("ts").alias("created_at"), F.count("*").alias("cases"))
    for early in (True, False):
        store.append_summary(runs.where((F.col("run_id") < "error") == early), path)
    return store.recent_summaries(spark.read.parquet(path), 3).select("run_id", "created_at", "cases")


@query("SELECT CAST(event_id AS VARCHAR) AS frame_id, event_type AS frame_type, CAST(user_id AS VARCHAR) AS request_id, CAST(event_id + 1 AS INTEGER) AS sequence FROM events")
def event_frames(spark, d):
    """Events as server-sent frames, with comments and data over two lines, read back."""
    path = new_path(spark, "frames")
    body = F.concat(F.lit('{"request_id": "'), F.col("user_id").cast("string"), F.lit('",\ndata: "sequence": '), (F.col("event_id") + 1).cast("string"), F.lit("}\n"))
    frame = F.concat(F.lit(": kept alive\nid: "), F.col("event_id").cast("string"), F.lit("\nevent: "), "event_type", F.lit("\ndata: "), body)
    table(spark, d, "events").select(frame.alias("value")).write.text(path)
    return ev.read_event_log(spark, path, frames=True).select("frame_id", "frame_type", "event.request_id", F.col("event.sequence").cast("int").alias("sequence"))


@query("SELECT CAST(user_id AS VARCHAR) AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id FROM events")
def distinct_events(spark, d):
    """Events of which every one comes again later under the same number."""
    numbered = table(spark, d, "events").select(F.col("user_id").cast("string").alias("request_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("sequence"), "ts", "event_id")
    again = numbered.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).withColumn("event_id", F.lit(-1).cast(dict(numbered.dtypes)["event_id"]))
    return ev.distinct_events(numbered.unionByName(again)).select("request_id", "sequence", "event_id")


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS record_id, length(coalesce(text, '')) AS n_chars FROM documents")
def ingested_documents(spark, d):
    """Documents as a stream into a store, twice: the second run, from its start, adds nothing."""
    path, source = new_path(spark, "ingested"), new_path(spark, "arriving")
    texts = spread(table(spark, d, "documents").select("text"))
    texts.write.parquet(source)
    build = lambda df: df.select(tx.sha256(F.coalesce("text", F.lit(""))).alias("record_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    held = KeyedStore(spark, path)
    for _ in range(2):
        pages = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 100).parquet(source)
        ingest_stream(pages, held, build, new_path(spark, "progress")).awaitTermination()
    return held.records().select("record_id", "n_chars")


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS q, v.vec_id AS v, q.label = v.label AND q.vec_id % 3 = v.vec_id % 3 AS relevant, greatest(0, 1 - list_cosine_similarity(q.e, v.e)) AS distance FROM e q, e v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY distance, CAST(v AS VARCHAR)) AS INTEGER) AS rank FROM s)
SELECT CAST(q AS VARCHAR) AS query_id, CAST(v AS VARCHAR) AS chunk_id, rank, relevant FROM r WHERE rank <= 20""")
def labelled_results(spark, d):
    """Neighbours, relevant where they stand in the place that the query's case names: its label's file, page 1, its third."""
    queries, vectors = vector_tables(spark, d)
    place = lambda key, *names: table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias(key), F.concat(F.lit("label-"), F.col("label").cast("string")).alias(names[0]), F.lit(1).alias(names[1]), (F.col("vec_id") % 3).cast("int").alias(names[2]))
    found = retrieval.knn(queries, vectors, 20).select("query_id", F.col("vector_id").alias("chunk_id"), "rank")
    cases = place("query_id", "relevant_document", "relevant_page", "relevant_chunk_index")
    return evaluate.label_results(found, place("chunk_id", "filename", "page_number", "chunk_index"), cases).select("query_id", "chunk_id", "rank", "relevant")


LINES = "SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS t FROM documents WHERE text IS NOT NULL"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


@query(rf"""WITH l AS ({LINES}), h AS (SELECT doc_id, length(t) <= 120 AND len(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}_]+(?:[''’-][\p{{L}}\p{{M}}\p{{N}}_]+)*|[^\p{{L}}\p{{M}}\p{{N}}_\s]')) <= 16 AND NOT regexp_matches(t, '[.?!;]\z') AND regexp_matches(t, '\p{{L}}') AND (
  (regexp_matches(t, '\p{{Lu}}') AND NOT regexp_matches(t, '[\p{{Ll}}\p{{Lt}}]')) OR (regexp_matches(t, '[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches(t, '(?:^|[^{CASED}])\p{{Ll}}') AND NOT regexp_matches(t, '[{CASED}][\p{{Lu}}\p{{Lt}}]'))
  OR regexp_matches(t, ':\z') OR regexp_matches(t, '^(?:{corpus.NUMBERED.pattern})')) AS heading FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (heading) AS n_headings FROM h GROUP BY 1""")
def headings(spark, d):
    docs = spread(table(spark, d, "documents")).where("text is not null")
    lines = docs.select("doc_id", F.explode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("t"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(corpus.is_heading(F.col("t"))).alias("n_headings"))


@query(f"WITH a AS (SELECT doc_id, {ALL} AS l FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, p AS pos, l[p] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM a)), g AS (SELECT doc_id, t, min(pos) AS pos FROM f GROUP BY ALL) SELECT doc_id, count(*) AS n_terms, sha256(string_agg(t, ' ' ORDER BY pos)) AS terms_sha256 FROM g GROUP BY 1")
def unique_terms(spark, d):
    terms = spread(table(spark, d, "documents")).select("doc_id", tx.unique_in_order(tx.all_tokens(tx.fold_text(F.col("text")))).alias("t")).where("size(t) > 0")
    return terms.select("doc_id", F.size("t").cast("long").alias("n_terms"), tx.sha256(F.array_join("t", " ")).alias("terms_sha256"))


CASE = "{'case_id': conv_id || ':' || turn, 'expected_route': CASE WHEN turn % 2 = 0 THEN 'document_search' ELSE 'direct_answer' END, 'expected_tool': role, 'kind': 'routing', 'query': text}"


@query(f"""WITH l AS (SELECT 'part-' || (turn % 4) AS dataset_id, 'case:routing:' || conv_id || ':' || turn AS name, sha256(CAST(to_json({CASE}) AS VARCHAR)) AS digest FROM conversations
  UNION ALL SELECT 'part-' || (doc_id % 4), 'asset:doc-' || doc_id || '.txt', sha256(coalesce(text, '')) FROM documents),
n AS (SELECT dataset_id, substr(sha256(name), 1, 3) AS node, sha256(string_agg(name || '=' || digest, chr(10) ORDER BY encode(name || '=' || digest))) AS digest FROM l GROUP BY ALL)
SELECT dataset_id, sha256(string_agg(node || '=' || digest, chr(10) ORDER BY node)) AS checksum FROM n GROUP BY 1""")
def dataset_checksums(spark, d):
    """Turns as routing cases of four datasets, with the documents as their assets."""
    part = lambda c: F.concat(F.lit("part-"), (F.col(c) % 4).cast("string")).alias("dataset_id")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    route = F.when(F.col("turn") % 2 == 0, "document_search").otherwise("direct_answer")
    turns = table(spark, d, "conversations").select(part("turn"), F.lit("routing").alias("kind"), key.alias("case_id"), F.col("text").alias("query"), route.alias("expected_route"), F.col("role").alias("expected_tool"))
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    assets = table(spark, d, "documents").select(part("doc_id"), path.alias("path"), tx.sha256(F.coalesce("text", F.lit(""))).alias("checksum"))
    return tx.dataset_checksum(turns, assets)


@query("""WITH f AS (SELECT 'page-' || page_id || CASE WHEN page_id % 7 = 0 THEN '.txt' WHEN page_id % 7 = 1 THEN '.PDF' ELSE '.pdf' END AS filename,
  CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN coalesce(html, '') ELSE '%PDF-1.7' || chr(10) || coalesce(html, '') END AS body FROM pages)
SELECT filename, strlen(body)::BIGINT AS size_bytes, sha256(body) AS checksum, CASE WHEN lower(filename) NOT LIKE '%.pdf' THEN 'UNSUPPORTED_EXTENSION' WHEN body = '' THEN 'EMPTY_FILE' WHEN strlen(body) > 3000 THEN 'FILE_TOO_LARGE'
  WHEN NOT contains(body[1:1024], '%PDF-') THEN 'BAD_SIGNATURE' END AS reason FROM f""")
def admitted_files(spark, d):
    """Pages written as files, some empty, of other kinds or too large, and admitted as documents."""
    n = F.col("page_id")
    name = F.concat(F.lit("page-"), n.cast("string"), F.when(n % 7 == 0, ".txt").when(n % 7 == 1, ".PDF").otherwise(".pdf"))
    html = F.coalesce("html", F.lit(""))
    body = F.when(n % 5 == 0, F.lit("")).when(n % 5 == 1, html).otherwise(F.concat(F.lit("%PDF-1.7\n"), html))
    folder = new_path(spark, "uploads")
    write_files(spread(table(spark, d, "pages")).select(name.alias("filename"), F.encode(body, "UTF-8").alias("content")), folder)
    return admit_files(spark, folder, "pdf", 3000).drop("path")


@query("""WITH o AS (SELECT event_id, floor(value)::BIGINT AS v, event_type AS t FROM events)
SELECT event_id::VARCHAR AS op_id, CASE WHEN t = 'view' AND v % 3 = 0 THEN 'UNKNOWN_COLUMN' WHEN t = 'click' AND v % 4 = 0 THEN 'BAD_GROUPING' WHEN t = 'purchase' AND v % 2 = 0 THEN 'NOT_NUMERIC' WHEN t = 'signup' AND v % 2 = 0 THEN 'COLUMN_REQUIRED'
  WHEN t = 'error' AND v % 3 = 0 THEN 'BAD_ALIAS' WHEN v % 11 = 0 THEN 'BAD_LIMIT' END AS reason,
  CASE WHEN t = 'view' AND v % 3 = 0 THEN 'no_' || v WHEN t = 'purchase' AND v % 2 = 0 THEN 'o_orderstatus' ELSE '' END AS detail FROM o""")
def checked_operations(spark, d):
    """A requested operation on orders for each event, with faults by rule, checked against the columns of orders."""
    v, of = F.floor("value").cast("int"), lambda kind, n: (F.col("event_type") == kind) & (F.floor("value").cast("int") % n == 0)
    field = F.when(of("purchase", 2), "o_orderstatus").when(of("signup", 2), F.lit(None)).otherwise("o_totalprice")
    agg = F.struct(F.lit("sum").alias("fn"), field.alias("field"), F.when(of("error", 3), "not an alias").otherwise("total").alias("alias"))
    keys = F.when(of("click", 4), F.array().cast("array<string>")).otherwise(F.array(F.when(of("view", 3), F.concat(F.lit("no_"), v.cast("string"))).otherwise("o_orderpriority")))
    limit = F.when(v % 11 == 0, 0).otherwise(10)
    asked = table(spark, d, "events").select(F.col("event_id").cast("string").alias("op_id"), F.lit(True).alias("grouped"), keys.alias("keys"), F.array(agg).alias("aggs"), F.array(F.lit("o_orderdate")).alias("sort"), F.lit(None).cast("array<string>").alias("columns"), limit.alias("limit"))
    fields = table(spark, d, "orders").schema.fields
    schema = spark.createDataFrame([(f.name, analytics.kind(f)) for f in fields], "name string, data_type string")
    return analytics.check_operations(asked, schema)
