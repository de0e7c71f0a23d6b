"""Text scalars over whole columns: folding, tokens, phrases, estimates, routing, ids and checksums."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: words and patterns that results depend on ---
QUERY_STOP_WORDS = ["a", "an", "and", "are", "do", "does", "for", "how", "in", "is", "it", "of", "on", "please", "the", "this", "to", "what", "when", "where", "which", "who", "why", "with"]
TOKEN = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*"
ESTIMATE = r"(?U)\w+(?:['’-]\w+)*|[^\w\s]"
LEADING_REQUEST = r"(?i)^(?:please\s+)?(?:find|locate|look\s+up|search\s+for|show\s+me|tell\s+me)\s+"
SOURCE_SUFFIX = r"(?i)\s+(?:in|from)\s+(?:(?:my|the|uploaded)\s+)?(?:documents?|pdfs?|files?)\.?$"
ANALYTICS_TERMS = ["aggregate", "average", "calculate", "compare", "count", "csv", "data", "dataset", "group by", "mean", "revenue", "sales", "sum", "table", "top"]
VIDEO_TERMS = ["clip", "frame", "minute", "scene", "timestamp", "transcript", "video", "watch"]
DOCUMENT_TERMS = ["contract", "document", "file", "page", "pdf", "policy", "report", "section"]
# --- end of fixed values ---


@F.pandas_udf(T.StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for (TXT1-3)."""
    return texts.map(lambda t: None if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold())


def normalize_query(text: Column) -> Column:
    """TXT1: the question without request phrase, source phrase and end marks; as it was if nothing is left."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, LEADING_REQUEST, ""), SOURCE_SUFFIX, ""), r"^[ .?!]+|[ .?!]+$", "")
    return fold_text(F.when(bare == "", flat).otherwise(bare))


def all_tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def without(tokens: Column, stop_words: list[str]) -> Column:
    """Duplicates stay, unlike with array_except."""
    stop = F.array(*map(F.lit, stop_words))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def tokenize(text: Column) -> Column:
    """TXT2: retrieval tokens in order, without stop words."""
    return without(all_tokens(fold_text(text)), QUERY_STOP_WORDS)


def normalized_phrase(text: Column) -> Column:
    """TXT3: all tokens joined by blanks."""
    return F.array_join(all_tokens(fold_text(text)), " ")


def estimate_tokens(text: Column) -> Column:
    """TXT4: words, with inner marks, and single marks."""
    return F.regexp_count(text, F.lit(ESTIMATE))


def normalize_block(text: Column) -> Column:
    """TXT5: one block of page text on one line, words joined that a line end had split."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "­", ""), " ", " "), r"\r\n?", "\n")
    joined = F.regexp_replace(plain, r"(?U)(\w)-[ \t]*\n[ \t]*(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(joined, r"(?U)\s+", " "), r"^ | $", "")


def safe_filename(name: Column) -> Column:
    """TXT7: the last part of a path; null if empty, over 255 characters or with control characters."""
    base = F.regexp_replace(F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), r"(?U)^\s+|\s+$", "")
    bad = (base == "") | base.isin(".", "..") | (F.char_length(base) > 255) | base.rlike(r"[\p{Cc}\p{Cf}]")
    return F.when(~bad, base)


def mentions(text: Column, terms: list[str]) -> Column:
    return F.lower(text).rlike(r"(?U)\b(?:" + "|".join(terms) + r")\b")


def route(text: Column) -> Column:
    """TXT8: where a question goes, the first kind of term found deciding."""
    return F.when(mentions(text, ANALYTICS_TERMS), "data_analytics").when(mentions(text, VIDEO_TERMS), "video_search").when(mentions(text, DOCUMENT_TERMS), "document_search").otherwise("direct_answer")


def route_queries(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("route", route(F.col(text_col)))


def relevance_proxy(answer: Column, terms: Column) -> Column:
    """TXT9: the share of expected terms whose phrase stands in the answer. Both are phrases already (normalized_phrase)."""
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(answer, t))) / F.size(terms)).otherwise(0.0)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def chunk_id(document_id: Column, page: Column, index: Column, text: Column) -> Column:
    """HSH1."""
    return F.concat(F.lit("chunk_"), F.substring(sha256(F.concat_ws(":", document_id, page.cast("string"), index.cast("string"), text)), 1, 24))


def seconds(value: Column) -> Column:
    """Three decimals, by rounding to thousandths first: Spark's format rounds halves otherwise than others do."""
    return F.format_string("%.3f", F.round(value, 3))


def segment_id(video_id: Column, start: Column, end: Column) -> Column:
    """HSH1."""
    return F.concat(F.lit("segment_"), F.substring(sha256(F.concat_ws(":", video_id, seconds(start), seconds(end))), 1, 24))


def fingerprint(config: Column) -> Column:
    """HSH2: of a struct whose fields are in key order."""
    return sha256(F.to_json(config))


def dataset_checksum(cases: DataFrame, assets: DataFrame) -> DataFrame:
    """HSH2: dataset_id, checksum over a dataset's cases and the checksums of its assets, as a tree of hashes.

    cases: dataset_id, kind, case_id and further fields; assets: dataset_id, path, checksum. Leaves are named digests; those whose names'
    hashes begin alike, one 4096th each, are a node, in order of name; the root is over the nodes. So neither the order of rows nor
    their partitions matter, and no task holds more than a node's leaves.
    """
    fields = sorted(c for c in cases.columns if c != "dataset_id")
    name = lambda *parts: F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
    own = cases.select("dataset_id", name(F.lit("case"), "kind", "case_id").alias("name"), sha256(F.to_json(F.struct(*fields))).alias("digest"))
    leaves = own.unionByName(assets.select("dataset_id", name(F.lit("asset"), "path").alias("name"), F.col("checksum").alias("digest")))
    joined = lambda a, b: sha256(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(a), F.lit("="), F.col(b)))), "\n"))
    nodes = leaves.groupBy("dataset_id", F.substring(sha256(F.col("name")), 1, 3).alias("node")).agg(joined("name", "digest").alias("digest"))
    return nodes.groupBy("dataset_id").agg(joined("node", "digest").alias("checksum"))


def unique_in_order(items: Column) -> Column:
    """SET4."""
    return F.array_distinct(items)
