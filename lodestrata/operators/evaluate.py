"""Metrics of retrieval, routing, guards, generation and invocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_results(results: DataFrame, chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """JOI7: results with `relevant`: whether the chunk is the one its query's case names."""
    placed = results.join(chunks.select("chunk_id", "filename", "page_number", "chunk_index"), "chunk_id")
    wanted = cases.select("query_id", F.col("relevant_document").alias("filename"), F.col("relevant_page").alias("page_number"), F.col("relevant_chunk_index").alias("chunk_index"), F.lit(True).alias("_hit"))
    return placed.join(wanted, ["query_id", "filename", "page_number", "chunk_index"], "left").withColumn("relevant", F.coalesce("_hit", F.lit(False))).drop("_hit")


def retrieval_metrics(results: DataFrame, cases: DataFrame, k: int, modes: list[str] | None = None) -> DataFrame:
    """AGG9: recall_at_k and mrr by mode, over all cases. results: mode, query_id, rank, relevant.

    modes: names, few, of which each has a row also where results have none of it; without, those that results have.
    """
    first = results.where("relevant").groupBy("mode", "query_id").agg(F.min("rank").alias("first"))
    named = results.select("mode").distinct() if modes is None else results.sparkSession.createDataFrame([(m,) for m in modes], "mode string")
    every = cases.select("query_id").distinct().crossJoin(F.broadcast(named))
    scored = every.join(first, ["mode", "query_id"], "left")
    hit = F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))
    return scored.groupBy("mode").agg(F.round(F.avg(hit), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("cases"))


def rate(test: Column) -> Column:
    return F.round(F.avg(F.coalesce(test, F.lit(False)).cast("int")), 4)


def routing_metrics(cases: DataFrame) -> DataFrame:
    """AGG10: of route, expected_route, tool, expected_tool."""
    return cases.agg(rate(F.col("route") == F.col("expected_route")).alias("route_accuracy"), rate(F.col("tool") == F.col("expected_tool")).alias("tool_accuracy"), F.count("*").alias("cases"))


def guard_metrics(inputs: DataFrame, grounding: DataFrame) -> DataFrame:
    """AGG10: inputs: input_passed, injection_detected, injection_expected; grounding: grounding_reasons, grounding_block,
    grounding_rewrite, unsupported_expected. Block and rewrite rates are over the cases of both."""
    i = inputs.agg(rate(F.col("injection_detected") == F.col("injection_expected")).alias("injection_accuracy"), F.count_if(~F.col("input_passed")).alias("b1"), F.count("*").alias("n1"))
    g = grounding.agg(rate(F.array_contains("grounding_reasons", "GROUNDING_UNSUPPORTED_CLAIM") == F.col("unsupported_expected")).alias("unsupported_accuracy"), F.count_if("grounding_block").alias("b2"), F.count_if("grounding_rewrite").alias("r2"), F.count("*").alias("n2"))
    total = F.greatest(F.col("n1") + F.col("n2"), F.lit(1))
    return i.crossJoin(g).select("injection_accuracy", "unsupported_accuracy", F.round((F.col("b1") + F.col("b2")) / total, 4).alias("block_rate"), F.round(F.col("r2") / total, 4).alias("rewrite_rate"))


def generation_metrics(answers: DataFrame) -> DataFrame:
    """AGG11: means of groundedness, citation_coverage, relevance."""
    return answers.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("groundedness", "citation_coverage", "relevance")])


def system_metrics(observations: DataFrame) -> DataFrame:
    """AGG12: of total_ms, retrieval_ms, generation_ms, guard_ms, and calls: array of struct with token_usage (null ones skipped)."""
    used = lambda part: F.sum(F.aggregate("calls", F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c["token_usage"][part].cast("long"), F.lit(0).cast("long")))).alias(f"{part}_tokens")
    sums = [F.round(F.sum(c), 3).alias(c) for c in ("total_ms", "retrieval_ms", "generation_ms", "guard_ms")]
    return observations.agg(F.count("*").alias("invocations"), *sums, F.sum(F.size("calls")).alias("provider_calls"), used("input"), used("output"), used("total"))
