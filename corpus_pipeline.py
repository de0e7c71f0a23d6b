"""A training-data pipeline over `documents` in five stages, each written as Parquet and read again by the next.

language_id       documents whose text is null, has no letter or whose best language scores under MIN_SCORE go
line_dedup        runs of lines that repeat earlier runs go; a document left without a word goes
ngram_join        one document of each group of near copies stays: that of the smallest doc_id
decontaminate     documents that hold a benchmark passage go
piece_codec       ids of the texts under a sentencepiece model, and their decoded text

Rows are judged by their own text, also where they share an id or have none. All but the last return the columns of `documents`;
n_chars follows the text. Rows with a null doc_id that are near copies of each other only stay as they are, for want of an id to keep.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, language_id, line_dedup, ngram_join, piece_codec
from lodestrata.llm._shared import shared_folder, table

MIN_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(table(spark, sf_dir, "documents"))
    found = language_id.identify(docs, model, lang_pred="_lang", score="_score")
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= MIN_SCORE)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    return out.where(F.col("text").rlike(r"\S")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(docs, 5, Fraction(8, 10), text_hash="_gone_hash")
    gone = found.where("component_id != doc_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("_gone"), "_gone_hash").distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_gone_hash")), "left_anti").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.encode_decode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), keep=False)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("piece_codec", to_pieces),
]

#: Not expressible: the language model's scores decide the first stage. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
