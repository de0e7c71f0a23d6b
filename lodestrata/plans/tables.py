"""Queries of table analytics and of the store's upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import analytics as a
from lodestrata.plans.common import cents, query, rounded, table
from lodestrata.sources import store

# ---- analytics ----


@query("SELECT count(*) AS value FROM lineitem")
def count_rows(spark, d):
    return a.count_rows(table(spark, d, "lineitem"))


@query("SELECT count(l_shipdate) AS value FROM lineitem")
def count_non_null(spark, d):
    return a.count_rows(table(spark, d, "lineitem"), "l_shipdate")


@query("SELECT round(sum(l_quantity), 4) AS value FROM lineitem")
def metric_sum(spark, d):
    return rounded(a.single_metric(table(spark, d, "lineitem"), "sum", "l_quantity"), "value")


@query("SELECT round(avg(l_discount), 4) AS value FROM lineitem")
def metric_mean(spark, d):
    return rounded(a.single_metric(table(spark, d, "lineitem"), "mean", "l_discount"), "value")


@query("SELECT min(l_extendedprice) AS value FROM lineitem")
def metric_min(spark, d):
    return a.single_metric(table(spark, d, "lineitem"), "min", "l_extendedprice")


@query("SELECT max(l_extendedprice) AS value FROM lineitem")
def metric_max(spark, d):
    return a.single_metric(table(spark, d, "lineitem"), "max", "l_extendedprice")


@query("""WITH g AS (SELECT coalesce(l_returnflag, '') AS l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY 1)
SELECT *, (SELECT count(*) FROM g) AS group_count, least((SELECT count(*) FROM g), 100) AS returned_rows FROM g ORDER BY l_returnflag LIMIT 100""")
def group_sum_by_flag(spark, d):
    return rounded(a.group_by(table(spark, d, "lineitem"), ["l_returnflag"], "sum", "l_quantity"), "sum_l_quantity", places=2)


@query("""WITH g AS (SELECT coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority, coalesce(CAST(c_nationkey AS VARCHAR), '') AS c_nationkey, floor(avg(o_totalprice) * 100 + 0.500001) / 100 AS mean_o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
SELECT *, (SELECT count(*) FROM g) AS group_count, least((SELECT count(*) FROM g), 500) AS returned_rows FROM g ORDER BY o_orderstatus, o_orderpriority, c_nationkey LIMIT 500""")
def group_three_keys(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = a.group_by(joined, ["o_orderstatus", "o_orderpriority", "c_nationkey"], "mean", "o_totalprice", 500)
    return cents(found, "mean_o_totalprice")


MULTI = [{"fn": "count", "alias": "n_rows"}, {"fn": "sum", "field": "l_quantity", "alias": "quantity"}, {"fn": "mean", "field": "l_extendedprice", "alias": "mean_price"}, {"fn": "min", "field": "l_tax", "alias": "least_tax"}, {"fn": "max", "field": "l_tax", "alias": "most_tax"}, {"fn": "count", "field": "l_comment", "alias": "x"}]


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n_rows, floor(sum(l_quantity) * 100 + 0.500001) / 100 AS quantity, floor(avg(l_extendedprice) * 100 + 0.500001) / 100 AS mean_price, min(l_tax) AS least_tax, max(l_tax) AS most_tax
FROM lineitem GROUP BY ALL ORDER BY 1, 2 LIMIT 100""")
def multi_aggregate(spark, d):
    return cents(a.aggregate(table(spark, d, "lineitem"), MULTI[:5], ("l_returnflag", "l_linestatus")), "quantity", "mean_price")


@query("SELECT count(*) AS n_rows, floor(sum(l_quantity) * 100 + 0.500001) / 100 AS quantity, floor(avg(l_extendedprice) * 100 + 0.500001) / 100 AS mean_price, min(l_tax) AS least_tax, max(l_tax) AS most_tax FROM lineitem")
def global_aggregate(spark, d):
    return cents(a.aggregate(table(spark, d, "lineitem"), MULTI[:5]), "quantity", "mean_price")


@query("""SELECT 'o_orderkey' AS "column", 'number' AS data_type, count(o_orderkey) AS non_null_count, count(DISTINCT o_orderkey) AS unique_count, min(o_orderkey)::DOUBLE AS min, max(o_orderkey)::DOUBLE AS max, floor(avg(o_orderkey) * 100 + 0.500001) / 100 AS mean FROM orders
UNION ALL SELECT 'o_totalprice', 'number', count(o_totalprice), count(DISTINCT o_totalprice), min(o_totalprice), max(o_totalprice), floor(avg(o_totalprice) * 100 + 0.500001) / 100 FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus), count(DISTINCT o_orderstatus), NULL, NULL, NULL FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority), count(DISTINCT o_orderpriority), NULL, NULL, NULL FROM orders""")
def describe_orders(spark, d):
    return cents(a.describe(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]), "mean")


@query("""SELECT * FROM (VALUES ('o_orderkey', 'number', false), ('o_custkey', 'number', false), ('o_orderstatus', 'string', false), ('o_totalprice', 'number', false), ('o_orderdate', 'string', false), ('o_orderpriority', 'string', false), ('is_open', 'boolean', false), ('empty', 'string', true)) AS t(name, data_type, nullable)""")
def infer_types(spark, d):
    o = table(spark, d, "orders")
    text = o.select(*[F.col(c).cast("string").alias(c) for c in o.columns], (F.col("o_orderstatus") == "O").cast("string").alias("is_open"), F.lit(None).cast("string").alias("empty"))
    return a.infer_schema(text)


@query("SELECT * FROM customer ORDER BY lower(c_mktsegment) DESC NULLS LAST, c_acctbal ASC NULLS LAST, c_custkey LIMIT 200")
def sort_nulls_last(spark, d):
    return a.sort_rows(table(spark, d, "customer"), [("c_mktsegment", "desc"), ("c_acctbal", "asc")], 200, "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def top_n_price(spark, d):
    return a.top_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50, "o_orderkey")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def list_recent(spark, d):
    return a.list_recent(table(spark, d, "events").select("event_id", "ts", "user_id"), 100, "ts", "event_id")


# ---- store ----


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def owner_filter(spark, d):
    from lodestrata.operators.retrieval import filter_owners

    ids = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return filter_owners(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ids, "l_orderkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_owners(spark, d):
    return store.delete_owners(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id")


@query("""SELECT *, CASE WHEN missing = 0 AND stale = 0 THEN 'equal' ELSE 'rebuild' END AS verdict FROM (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS durable_count, (SELECT count(DISTINCT vec_id) FROM embeddings) AS indexed_count, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings)) AS missing,
(SELECT count(*) FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents)) AS stale)""")
def reconcile_index(spark, d):
    return store.reconcile(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""SELECT pos, doc_id, source, n_chars FROM (VALUES (0, 17), (1, 3), (2, 999999999), (3, 101), (4, 42)) AS t(pos, doc_id) JOIN documents USING (doc_id)""")
def get_by_ids(spark, d):
    return store.get_by_ids(table(spark, d, "documents").select("doc_id", "source", "n_chars"), [17, 3, 999999999, 101, 42], "doc_id").select("pos", "doc_id", "source", "n_chars")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, 'document' AS kind, source AS filename FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR), 'video', url FROM pages UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'dataset', p_name FROM part""")
def catalogue(spark, d):
    named = lambda t, key, name: table(spark, d, t).select(F.col(key), F.col(name).alias("filename"))
    return store.catalogue(named("documents", "doc_id", "source"), named("pages", "page_id", "url"), named("part", "p_partkey", "p_name"))


@query("""WITH t AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 50 GROUP BY 1)
SELECT *, only_claimed = 0 AND only_true = 0 AS matches FROM (SELECT (SELECT count(*) FROM (FROM c EXCEPT ALL FROM t)) AS only_claimed, (SELECT count(*) FROM (FROM t EXCEPT ALL FROM c)) AS only_true)""")
def results_match(spark, d):
    items = table(spark, d, "lineitem")
    counts = lambda df: df.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return store.results_match(counts(items.where("l_quantity < 50")), counts(items))


@query("""WITH g AS (SELECT p_brand, avg(p_retailprice) AS price FROM part GROUP BY 1)
SELECT count(*) AS n_rows, count(*) FILTER (price IS NULL OR NOT isfinite(price)) AS bad_values, count(*) FILTER (trim(p_brand) = '' OR p_brand SIMILAR TO '.*[<>].*' OR p_brand IS NULL) AS bad_labels, true AS keys_valid, count(*) <= 100 AND bad_values = 0 AND bad_labels = 0 AS valid FROM g""")
def check_chart_rows(spark, d):
    return store.check_chart_rows(table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("price")), "p_brand", "price")


@query("""SELECT o_orderkey AS upload_id, CASE WHEN o_orderstatus = 'P' THEN 'WRONG_ASSET_TYPE' WHEN o_orderpriority = '5-LOW' THEN 'ALREADY_CONSUMED' WHEN o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1997-01-01' THEN 'EXPIRED'
  WHEN s.n IS NULL THEN 'OBJECT_MISSING' WHEN s.n <> 4 THEN 'SIZE_MISMATCH' END AS reason FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey""")
def valid_intents(spark, d):
    o = table(spark, d, "orders")
    intents = o.select(F.col("o_orderkey").alias("upload_id"), F.col("o_orderkey").alias("object_path"), F.when(F.col("o_orderstatus") == "P", "video").otherwise("document").alias("asset_type"), F.lit(4).alias("size_bytes"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"), F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("consumed_at"))
    objects = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_path")).agg(F.count("*").alias("stored_bytes"))
    return store.valid_intents(intents, objects, "1997-01-01 00:00:00", "document").select("upload_id", "reason")


@query("""SELECT sha256(coalesce(text, '')) AS checksum, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_documents(spark, d):
    from lodestrata.functions.text import sha256
    from lodestrata.operators.corpus import duplicate_checksums

    return duplicate_checksums(table(spark, d, "documents").select(sha256(F.coalesce("text", F.lit(""))).alias("checksum")))


@query("""SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS checksum, 'chunk_' || substr(sha256(doc_id || ':1:0:' || text), 1, 24) AS chunk_id FROM documents""")
def content_checksums(spark, d):
    from lodestrata.functions.text import chunk_id, sha256

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return docs.select("document_id", sha256(F.col("text")).alias("checksum"), chunk_id(F.col("document_id"), F.lit(1), F.lit(0), F.col("text")).alias("chunk_id"))
