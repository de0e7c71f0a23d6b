"""Benchmark decontamination with a broadcast set of n-gram hashes; DataFrame operations only.

A word is a run of characters other than ASCII punctuation, blanks and controls, with A-Z lower-cased. An item's
windows are its runs of `n` consecutive words; an item of fewer words is one window. Documents are scanned once: each
word position is hashed over the window length and looked up in the set of window hashes, which is broadcast while its
row count is within `broadcast_rows` and joined by a shuffle beyond that. Each hit is verified word by word.

Defined results: a null or empty text has no words and no hits; a null, empty or wordless item matches nothing; rows
that repeat a doc_id are judged by their own text, and equal rows come back as often as they went in; rows with a null
doc_id are kept. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import ascii_lower, sha256_of, staged, unused

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_AND_REST = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
BEFORE_WORDS = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def windows_of(items: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of all items: window array<string>, length, h, items array<string>."""
    words = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    size = F.size("words")
    length = F.least(size, F.lit(n))
    each = words.where(size > 0).select("item", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), size - length + 1), lambda i: F.slice("words", i, length))).alias("window"))
    return each.groupBy("window", "length").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("window"))


def hash_at(length: int) -> Column:
    """The hash of `length` words from position `at` on, as xxhash64 gives it for their array."""
    return F.xxhash64(*[F.get("words", F.col("at") + k) for k in range(length)])


def find_hits(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_rows: int = 2_000_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, hits (word positions from 0, sorted), items (sorted)."""
    windows = staged(windows_of(items, n, item_id, text), "windows")
    found = windows.groupBy("length").agg(F.count("*").alias("rows")).collect()  # one row per window length, n at most
    lengths = sorted(r["length"] for r in found) or [n]
    hashes = windows.select("h", "length").distinct()
    small = sum(r["rows"] for r in found) <= broadcast_rows
    if small:
        hashes = F.broadcast(hashes)
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("words"))
    # position -1 stands for the document itself, so that one scan gives both its word count and its hits
    at = words.withColumn("n_words", F.size("words")).select("*", F.explode_outer(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - lengths[0], F.lit(-1)))).alias("at"))
    if len(lengths) == 1:
        at = at.withColumn("length", F.lit(lengths[0]))
    else:
        at = at.select("*", F.explode_outer(F.array(*[F.lit(x) for x in lengths])).alias("length"))
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("length") <= F.col("n_words"))
    h = reduce(lambda rest, x: F.when(F.col("length") == x, hash_at(x)).otherwise(rest), lengths[1:], hash_at(lengths[0]))
    # documents' own rows have keys of their own and a length of no window, so that they are spread and match nothing
    at = at.where(fits | ((F.col("at") == -1) & (F.col("length") == lengths[0])))
    at = at.withColumn("h", F.when(fits, h).otherwise(F.xxhash64("doc_id", "text_hash")))
    length = F.when(F.col("at") >= 0, F.col("length")).otherwise(-1)
    own = F.when(F.col("at") >= 0, F.slice("words", F.col("at") + 1, F.col("length"))).alias("own")
    if not small:  # a shuffle follows: it carries each position's own words, not those of the whole text
        at = at.select("doc_id", "text_hash", "n_words", "at", "h", "length", F.when(fits, own).alias("own"))
        own = F.col("own")
    seen = at.withColumn("length", length).join(hashes.withColumn("known", F.lit(True)), ["h", "length"], "left")
    seen = seen.where(F.col("known") | (F.col("at") == -1)).select("doc_id", "text_hash", "n_words", "at", "h", "length", own)
    hit = seen.join(windows.select("h", "length", "window", "items"), ["h", "length"], "left")
    sure = F.col("own") == F.col("window")
    by_doc = hit.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("at") == -1).alias("copies"),
        F.array_distinct(F.flatten(F.collect_set(F.when(sure, F.sequence(F.col("at"), F.col("at") + F.col("length") - 1))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(sure, F.col("items")))))).alias("items"),
    )
    out = by_doc.select("doc_id", "text_hash", "n_words", F.size("hits").cast("long").alias("n_hit"), F.array_sort("hits").alias("hits"), "items", "copies")
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copies", "copy")


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any hit, with all their columns."""
    id_, hash_ = unused("bad_id", docs), unused("bad_hash", docs)
    bad = find_hits(docs, items, n, doc_id=doc_id, text=text).where("n_hit > 0").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad[id_]) & (F.xxhash64(docs[text]) == bad[hash_]), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the words of every hit taken out, each with what follows it up to the next word."""
    id_, hash_, hits_ = unused("hit_id", docs), unused("hit_hash", docs), unused("hits", docs)
    hits = find_hits(docs, items, n, doc_id=doc_id, text=text).where("n_hit > 0").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("hits").alias(hits_)).distinct()
    joined = docs.join(hits, docs[doc_id].eqNullSafe(hits[id_]) & (F.xxhash64(docs[text]) == hits[hash_]), "left")
    pieces = F.regexp_extract_all(text, F.lit(WORD_AND_REST), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(hits_)), lambda i: F.get(pieces, i))
    clean = F.concat(F.regexp_extract(text, BEFORE_WORDS, 0), F.array_join(kept, ""))
    return joined.select(*[F.when(F.col(hits_).isNull(), docs[c]).otherwise(clean).alias(c) if c == text else docs[c] for c in docs.columns])


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    from lodestrata.llm._shared import table

    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_of(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dp, lens WHERE i + n - 1 <= len(w)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
