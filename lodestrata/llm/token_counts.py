"""Token counts kept up by deltas: totals by source, language and tokenizer version under signed changes.

A change is (doc_id, source, lang, tokenizer, op, n_tokens): `insert` adds a document, `delete` takes it out, `revise` puts
another count in place of the one it has. A commit turns a batch of changes into signed entries (documents, tokens), by
joining deletes and revisions to the ledger's present counts, and writes two things under the batch's id: the entries, and
their sums by group. A batch is committed once its marker `_SUCCESS` in the sums' folder is there; committing its id again
then changes nothing, and a commit that broke off is written anew. Totals are the sums of all committed batches.

Defined results: a null source, language or tokenizer is a group of its own; null counts count 0 tokens. Within a batch the
last change of a (doc_id, tokenizer) by `order` holds, equal ones in an order fixed by their values; an insert of what the
ledger holds is a revision, and deletes and revisions of what it lacks do nothing. A revision also moves the document to the
group it now names. Rows with a null doc_id are one document. An empty batch commits and adds nothing.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm._shared import shared_folder, table

GROUP = ["source", "lang", "tokenizer"]
KEY = ["doc_id", "tokenizer"]
ENTRY = "doc_id long, source string, lang string, tokenizer string, d_docs long, d_tokens long"
SUMS = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


class Rollup:
    """The ledger and the sums under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _committed(self, kind: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/sums")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return [f"{self.folder}/{kind}/{n}" for n in sorted(names) if self._there(f"{self.folder}/sums/{n}/_SUCCESS")]

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = self._committed(kind)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """The present count of each document under each tokenizer."""
        sums = self._read("entries", ENTRY).groupBy("doc_id", *GROUP).agg(F.sum("d_docs").alias("docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("docs > 0").drop("docs")

    def totals(self) -> DataFrame:
        sums = self._read("sums", SUMS).groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")

    def commit(self, batch_id: str, changes: DataFrame, order: str | None = None) -> bool:
        """Add a batch. False, with nothing done, if its id is committed already."""
        if self._there(f"{self.folder}/sums/{batch_id}/_SUCCESS"):
            return False
        last = [F.desc_nulls_last(order)] if order else []
        newest = F.row_number().over(W.partitionBy(*KEY).orderBy(*last, F.desc("op"), F.desc("n_tokens"), "source", "lang"))
        new = changes.withColumn("_row", newest).where("_row = 1").select("doc_id", *GROUP, "op", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        old = self.ledger().select(*[F.col(c).alias(f"old_{c}") for c in ("doc_id", *GROUP, "n_tokens")], F.lit(True).alias("held"))
        both = new.join(old, new["doc_id"].eqNullSafe(old["old_doc_id"]) & new["tokenizer"].eqNullSafe(old["old_tokenizer"]), "left")
        put = F.struct("doc_id", *GROUP, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        take = F.struct("doc_id", *[F.col(f"old_{c}").alias(c) for c in GROUP], F.lit(-1).cast("long").alias("d_docs"), (-F.col("old_n_tokens")).alias("d_tokens"))
        taken = F.when(F.col("held"), take)
        added = F.when((F.col("op") == "insert") | ((F.col("op") == "revise") & F.col("held")), put)
        entries = both.select(F.explode(F.array_compact(F.array(taken, added))).alias("e")).select("e.*")
        entries.write.mode("overwrite").parquet(f"{self.folder}/entries/{batch_id}")
        mine = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/entries/{batch_id}")
        sums = mine.groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sums/{batch_id}")
        return True


@functools.cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of ids of texts, by a file of sentencepiece (.model) or tiktoken (.tiktoken) pieces."""
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: list(map(len, own.encode(texts, num_threads=1)))
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(other.encode_ordinary(t)) for t in texts]


def counted(docs: DataFrame, tokenizers: dict[str, str], text: str = "text") -> DataFrame:
    """docs with the count of ids of each whole text, under each tokenizer's name, in Arrow batches; null texts count 0.

    tokenizers: names and the paths of their files, which must be readable where tasks run. Names that are columns already are refused.
    """
    if clash := sorted(set(tokenizers) & set(docs.columns)):
        raise ValueError(f"columns {clash} are there already")
    schema = T.StructType(docs.schema.fields + [T.StructField(n, T.LongType()) for n in tokenizers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 250) for i in range(0, whole.num_rows, 250)):
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                own = [pa.array(counter(path)(texts), pa.int64()) for path in tokenizers.values()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], schema.names)

    return docs.mapInArrow(run, schema)


def pattern_count(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


#: Tokenizers by version: the text column's count. Blank-separated words; letter and digit runs or single marks.
VERSIONS = {"words-1": pattern_count(r"[^\x20\x09-\x0D]+"), "marks-2": pattern_count(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]")}
LICENSE = r"(?m)^(Released under|Licensed under|This work is licensed under|All rights reserved)[^\n]*$"


#: The query's tokenizers: version and file.
TOKENIZERS = {"piece_bpe_32k": "piece_bpe_32k.model", "byte_bpe_50k": "byte_bpe_50k.tiktoken"}


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer, kept up as `four_batches` says."""
    import public_tokenizers

    paths = {name: public_tokenizers.path(file) for name, file in TOKENIZERS.items()}
    return four_batches(spark, sf_dir, list(paths), lambda docs, names: counted(docs, {n: paths[n] for n in names}))


def token_pattern_counts(spark, sf_dir: str) -> DataFrame:
    """The same for tokenizers that are patterns, which SQL can count too."""
    return four_batches(spark, sf_dir, list(VERSIONS), lambda docs, names: docs.select("*", *[VERSIONS[n](F.col("text")).alias(n) for n in names]))


def four_batches(spark, sf_dir: str, names: list[str], count: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Totals after four batches over all documents, the second of them sent twice.

    Every document enters under the first tokenizer, then under the second; documents with license lines are revised to the
    count without them; of documents with equal texts all but the first are deleted.
    """
    import uuid

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")

    def changes(docs: DataFrame, some: list[str], op: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(n).alias("n_tokens")) for n in some]))
        return count(docs, some).select("doc_id", "source", "lang", each.alias("c")).select("doc_id", "source", "lang", "c.tokenizer", F.lit(op).alias("op"), "c.n_tokens")

    rollup.commit("1-first", changes(docs, names[:1], "insert"))
    rollup.commit("2-second", changes(docs, names[1:], "insert"))
    licensed = docs.where(F.col("text").rlike(LICENSE)).withColumn("text", F.regexp_replace("text", LICENSE, ""))
    rollup.commit("3-licenses", changes(licensed, names, "revise"))
    keyed = docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("h"), F.md5(F.encode("text", "UTF-8")).alias("m"))
    first = keyed.groupBy("h", "m").agg(F.min("doc_id").alias("first"))
    copies = keyed.join(first, ["h", "m"]).where("doc_id != first").select("doc_id", "source", "lang", F.explode(F.array(*map(F.lit, names))).alias("tokenizer"), F.lit("delete").alias("op"), F.lit(0).cast("long").alias("n_tokens"))
    rollup.commit("4-copies", copies)
    rollup.commit("2-second", changes(docs, names[1:], "insert"))
    return rollup.totals()


SQL = r"""
WITH d AS (SELECT *, CASE WHEN regexp_matches(text, '(?m)^(Released under|Licensed under|This work is licensed under|All rights reserved)[^\n]*$')
    THEN regexp_replace(text, '(?m)^(Released under|Licensed under|This work is licensed under|All rights reserved)[^\n]*$', '', 'g') ELSE text END AS bare,
    min(doc_id) OVER (PARTITION BY text) AS first FROM documents),
k AS (SELECT source, lang, bare FROM d WHERE text IS NULL OR doc_id = first),
t AS (SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(bare, ''), '[^\x20\x09-\x0D]+')) AS n FROM k
  UNION ALL SELECT source, lang, 'marks-2', len(regexp_extract_all(coalesce(bare, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) FROM k)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM t GROUP BY ALL
"""
