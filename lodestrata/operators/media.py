"""Timed media: representative timestamps, segment bounds, overlap with transcript spans, segment texts, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import seconds, segment_id
from lodestrata.operators.counted import knn_hashed
from lodestrata.operators.retrieval import rank_candidates, resolve_matches, similarity_floor
from lodestrata.sources.staging import staged

STEP_SECONDS, MAX_KEYFRAMES, MIN_SIMILARITY, SLOT_SECONDS = 30.0, 6, 0.1, 60.0


def representative_timestamps(media: DataFrame, step: float = STEP_SECONDS, limit: int = MAX_KEYFRAMES) -> DataFrame:
    """SEG1: video_id, idx, start_seconds: 0, step, 2 step ... before the end, `limit` at most, one at least."""
    count = F.greatest(F.lit(1), F.least(F.lit(limit), F.ceil(F.col("duration_seconds") / step).cast("int")))
    return media.select("video_id", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.round(i * F.lit(float(step)), 3))).alias("idx", "start_seconds"))


def segment_bounds(starts: DataFrame, media: DataFrame) -> DataFrame:
    """WIN4: a segment ends where the next begins, the last with the media."""
    after = F.lead("start_seconds").over(W.partitionBy("video_id").orderBy("start_seconds"))
    return starts.join(media.select("video_id", "filename", "duration_seconds"), "video_id").withColumn("end_seconds", F.coalesce(after, F.col("duration_seconds"))).drop("duration_seconds")


def overlap_spans(segments: DataFrame, spans: DataFrame, slot: float = SLOT_SECONDS) -> DataFrame:
    """JOI4: segments with the texts of the spans that overlap them, in span order; the empty text where none does.

    Both sides are laid out in slots of time, so that long media do not meet as a whole; touching ends do not overlap.
    """
    slots = lambda: F.explode(F.sequence(F.floor(F.col("start_seconds") / slot), F.floor(F.greatest("start_seconds", "end_seconds") / slot)))
    s = segments.select("video_id", F.col("start_seconds").alias("s0"), F.col("end_seconds").alias("s1"), slots().alias("slot"))
    t = spans.select("video_id", F.col("start_seconds").alias("t0"), F.col("end_seconds").alias("t1"), "text", slots().alias("slot"))
    # a pair that shares several slots counts in the first one
    shared = F.floor(F.greatest("s0", "t0") / slot) == F.col("slot")
    met = s.join(t, ["video_id", "slot"]).where((F.col("t0") < F.col("s1")) & (F.col("t1") > F.col("s0")) & shared)
    texts = met.groupBy("video_id", F.col("s0").alias("start_seconds"), F.col("s1").alias("end_seconds")).agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "text"))).alias("spans"))
    joined = segments.join(texts, ["video_id", "start_seconds", "end_seconds"], "left")
    return joined.withColumn("transcript", F.coalesce(F.array_join(F.col("spans.text"), " "), F.lit(""))).drop("spans")


def build_segments(media: DataFrame, spans: DataFrame, visuals: DataFrame, step: float = STEP_SECONDS, limit: int = MAX_KEYFRAMES) -> DataFrame:
    """SEG2: segments with transcript, visual description, combined text and id."""
    found = overlap_spans(segment_bounds(representative_timestamps(media, step, limit), media), spans)
    found = found.join(visuals.select("video_id", "idx", F.col("description").alias("visual_description")), ["video_id", "idx"], "left").fillna("", ["visual_description"])
    useful = F.when(F.col("visual_description").rlike(r"(disabled|unavailable)\.$"), "").otherwise(F.col("visual_description"))
    parts = F.filter(F.array("transcript", useful), lambda x: x != "")
    times = F.concat(F.lit("Video segment from "), seconds(F.col("start_seconds")), F.lit(" to "), seconds(F.col("end_seconds")), F.lit(" seconds; "), F.col("visual_description"))
    combined = F.when(F.size(parts) > 0, F.trim(F.array_join(parts, " "))).otherwise(times)
    return found.withColumn("combined_text", combined).withColumn("segment_id", segment_id(F.col("video_id"), F.col("start_seconds"), F.col("end_seconds")))


def media_rollup(segments: DataFrame) -> DataFrame:
    """AGG7: segment_count and processing_status of each video; partial if any description is unavailable."""
    return segments.groupBy("video_id").agg(F.count("*").alias("segment_count"), F.when(F.max(F.col("visual_description").endswith("unavailable.")), "partial").otherwise("completed").alias("processing_status"))


def search_segments(queries: DataFrame, segments: DataFrame, k: int = 5, min_score: float = MIN_SIMILARITY) -> DataFrame:
    """SEG3: the k nearest segments of each query with their times."""
    flat = queries.select("query_id", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"))
    segments = staged(segments, "segments")  # read for their order, their texts and the result
    near = knn_hashed(flat, segments.select(F.col("segment_id").alias("vector_id"), F.col("combined_text").alias("text")), k, min_score)
    found = resolve_matches(near.select("query_id", F.col("vector_id").alias("segment_id"), "distance"), segments, "segment_id")
    return rank_candidates(similarity_floor(found, min_score, tie="segment_id"), [F.col("rank")])
