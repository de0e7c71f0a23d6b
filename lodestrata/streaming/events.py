"""Request event logs as tables: reading, validation, order, state folding, metrics, limits, one-time use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.sources.staging import staged

# --- fixed values: event types, fields and limits ---
ROUTES = ["document_search", "video_search", "data_analytics", "direct_answer"]
TOOLS = ["document_search", "video_search"]
TERMINAL = ["response.completed", "error"]
TYPES = ["request.started", "route.selected", "retrieval.started", "retrieval.completed", "generation.started", "generation.token", "genui.created", "guardrail.completed", "response.completed", "error"]
ERROR_CODES = ["STREAM_TIMEOUT", "STREAM_FAILED", "UPSTREAM_DISCONNECTED"]
CITATION = "struct<citation_id: string, source_type: string, filename: string, page: int, start_seconds: double, end_seconds: double, locator: string>"
EVENT = (
    "schema_version string, request_id string, correlation_id string, sequence int, type string, thread_id string, route string, tool string, candidate_count int, latency_ms int, token string, index int, "
    "result struct<decision: string, groundedness_score: double, citation_coverage: double, schema_valid: boolean>, rewrite_count int, final_response string, citations array<" + CITATION + ">, citation_count int, "
    "components array<string>, code string, message string, retryable boolean"
)
PHASES = {"request.started": "Thinking", "generation.started": "Synthesizing", "generation.token": "Synthesizing", "guardrail.completed": "Validating", "response.completed": "Complete", "error": "Error"}
LABELS = {"request.started": "Request accepted", "route.selected": "Route selected", "retrieval.started": "Evidence search started", "retrieval.completed": "Evidence search completed", "generation.started": "Answer synthesis started", "genui.created": "Visual output validated", "guardrail.completed": "Sentinel validation completed", "response.completed": "Response completed", "error": "Request stopped"}
LIMIT, WINDOW_MS, TIMEOUT_SECONDS = 30, 60_000, 120
# --- end of fixed values ---


def read_event_log(spark: SparkSession, path: str, streaming: bool = False, frames: bool = False) -> DataFrame:
    """SRC8: JSON lines, or server-sent frames, as rows with `value`, `frame_id`, `frame_type` and the parsed `event`."""
    reader = spark.readStream if streaming else spark.read
    raw = (reader.option("lineSep", "\n\n") if frames else reader).text(path)
    rows = parse_sse_frames(raw) if frames else raw.withColumn("frame_id", F.lit(None).cast("string")).withColumn("frame_type", F.lit(None).cast("string"))
    return rows.withColumn("event", F.from_json("value", EVENT))


def parse_sse_frames(df: DataFrame) -> DataFrame:
    """SRC8: frames in `value` to frame_id, frame_type and value (the data lines, joined by newlines). Comments are passed over."""
    lines = F.filter(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n"), lambda x: (x != "") & ~x.startswith(":"))
    df = df.withColumn("_lines", lines)
    of = lambda name: F.transform(F.filter("_lines", lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    out = df.select(F.try_element_at(of("id"), F.lit(1)).alias("frame_id"), F.try_element_at(of("event"), F.lit(1)).alias("frame_type"), F.array_join(of("data"), "\n").alias("value"))
    return out.where("value != ''")


def within(column: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(column).between(low, high), F.lit(False))


def validate_events(df: DataFrame) -> DataFrame:
    """JSN1: rows of read_event_log with `reason`, null if the event is sound."""
    e = lambda name: F.col(f"event.{name}")
    least = lambda name, low, high=None: F.coalesce((e(name) >= low) & (F.lit(True) if high is None else e(name) <= high), F.lit(False))
    rules = {
        "request.started": within(e("thread_id"), 1, 128),
        "route.selected": F.coalesce(e("route").isin(ROUTES), F.lit(False)),
        "retrieval.started": F.coalesce(e("tool").isin(TOOLS), F.lit(False)),
        "retrieval.completed": F.coalesce(e("tool").isin(TOOLS), F.lit(False)) & least("candidate_count", 0, 100) & least("latency_ms", 0),
        "generation.started": F.coalesce(e("route").isin(ROUTES), F.lit(False)),
        "generation.token": within(e("token"), 1, 1000) & least("index", 0),
        "genui.created": F.coalesce(F.size(e("components")).between(1, 5), F.lit(False)),
        "guardrail.completed": e("result").isNotNull() & least("rewrite_count", 0, 1),
        "response.completed": within(e("final_response"), 1, 8000) & F.coalesce(F.size(e("citations")) <= 20, F.lit(False)) & least("latency_ms", 0) & least("rewrite_count", 0, 1),
        "error": F.coalesce(e("code").isin(ERROR_CODES), F.lit(False)) & within(e("message"), 1, 300) & e("retryable").isNotNull(),
    }
    sound = F.lit(False)
    for kind, rule in rules.items():
        sound = F.when(e("type") == kind, rule).otherwise(sound)
    base = within(e("request_id"), 1, 128) & within(e("correlation_id"), 1, 128) & least("sequence", 1) & (F.coalesce(e("schema_version"), F.lit("1.0")) == "1.0")
    count = (e("type") == "response.completed") & ~F.coalesce(e("citation_count") == F.size(e("citations")), F.lit(False))
    times = F.coalesce(F.exists(e("citations"), lambda c: (c["source_type"] == "video") & ~F.coalesce(c["end_seconds"] > c["start_seconds"], F.lit(False))), F.lit(False))
    frame = (F.col("frame_type").isNotNull() & (F.col("frame_type") != e("type"))) | (F.col("frame_id").isNotNull() & (F.col("frame_id") != e("sequence").cast("string")))
    reason = (
        F.when(e("type").isNull(), "NOT_AN_EVENT").when(~e("type").isin(TYPES), "UNKNOWN_TYPE").when(~base, "BAD_ENVELOPE").when(~sound, "BAD_FIELDS").when(count, "CITATION_COUNT_MISMATCH").when(times, "BAD_CITATION_TIMES").when(F.coalesce(frame, F.lit(False)), "FRAME_MISMATCH")
    )
    return df.withColumn("reason", reason)


def check_sequences(events: DataFrame) -> DataFrame:
    """WIN5: request_id, n_events, starts_at_one, contiguous, one_terminal_last, valid. events: request_id, sequence, type."""
    before = F.lag("sequence").over(W.partitionBy("request_id").orderBy("sequence"))
    steps = events.withColumn("step", F.col("sequence") - before).withColumn("terminal", F.col("type").isin(TERMINAL))
    out = steps.groupBy("request_id").agg(F.count("*").alias("n_events"), (F.min("sequence") == 1).alias("starts_at_one"), (F.count_if(F.col("step") != 1) == 0).alias("contiguous"), ((F.count_if("terminal") == 1) & F.coalesce(F.max(F.when(F.col("terminal"), F.col("sequence"))) == F.max("sequence"), F.lit(False))).alias("one_terminal_last"))
    return out.withColumn("valid", F.col("starts_at_one") & F.col("contiguous") & F.col("one_terminal_last"))


def distinct_events(events: DataFrame, ts: str = "ts") -> DataFrame:
    """STM7: one row for each (request_id, sequence): the first by time. In streams: dropDuplicatesWithinWatermark."""
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark(["request_id", "sequence"])
    return events.withColumn("_n", F.row_number().over(W.partitionBy("request_id", "sequence").orderBy(ts))).where("_n = 1").drop("_n")


FOLDED = ["phase", "route", "answer", "citations", "decision", "groundedness", "citation_coverage", "latency_ms", "rewrite_count", "error"]


def phase_of(kind: Column, tool: Column, route: Column) -> Column:
    searching = F.when(tool == "document_search", "Searching Documents").otherwise("Searching Video")
    out = F.when(kind == "route.selected", F.when(route == "data_analytics", "Analyzing Data").otherwise("Routing"))
    out = out.when(kind.isin("retrieval.started", "retrieval.completed"), searching)
    for name, phase in PHASES.items():
        out = out.when(kind == name, phase)
    return out


def label_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LABELS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def fold_requests(events: DataFrame) -> DataFrame:
    """STM1: the state of each request after all its events, by sequence.

    State is folded by kind: the last phase that an event sets, tokens joined unless a final response stands later,
    the last citations, quality and error, and the activity list. events: the columns of EVENT that are there, and ts.
    """
    have = set(events.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    at = F.col("sequence")
    e = events.select("request_id", "sequence", "type", col("tool", "string").alias("tool"), col("route", "string").alias("route"), col("token", "string").alias("token"), col("final_response", "string").alias("final_response"), col("citations", f"array<{CITATION}>").alias("citations"), (F.col("result") if "result" in have else F.lit(None).cast("struct<decision: string, groundedness_score: double, citation_coverage: double, schema_valid: boolean>")).alias("result"), col("latency_ms", "int").alias("latency_ms"), col("rewrite_count", "int").alias("rewrite_count"), col("message", "string").alias("message"))
    kind = F.col("type")
    last = lambda value, test: F.max_by(value, F.when(test, at))
    phase = phase_of(kind, F.col("tool"), F.col("route"))
    done, guarded = kind == "response.completed", kind == "guardrail.completed"
    folded = e.groupBy("request_id").agg(
        last(phase, phase.isNotNull()).alias("phase"), last(F.col("route"), kind == "route.selected").alias("route"),
        F.array_sort(F.collect_list(F.when(kind == "generation.token", F.struct(at.alias("at"), "token")))).alias("tokens"), last(F.col("final_response"), done).alias("final"), F.max(F.when(done, at)).alias("final_at"),
        last(F.col("citations"), done).alias("citations"), last(F.col("result"), guarded).alias("result"), F.max(F.when(guarded, at)).alias("guarded_at"), last(F.col("latency_ms"), done).alias("final_latency"),
        last(F.col("rewrite_count"), guarded).alias("guard_rewrites"), last(F.col("rewrite_count"), done).alias("final_rewrites"), last(F.col("message"), kind == "error").alias("error"),
        F.transform(F.array_sort(F.collect_list(F.when(label_of(kind).isNotNull(), F.struct(at.alias("at"), label_of(kind).alias("label"))))), lambda x: x["label"]).alias("activity"),
    )
    later = F.filter("tokens", lambda t: F.col("final_at").isNull() | (t["at"] > F.col("final_at")))
    answer = F.concat(F.coalesce("final", F.lit("")), F.array_join(F.transform(later, lambda t: t["token"]), ""))
    closed = (F.col("final_at") > F.col("guarded_at")) & F.col("guarded_at").isNotNull()
    return folded.select("request_id", F.coalesce("phase", F.lit("Idle")).alias("phase"), "route", answer.alias("answer"), F.coalesce("citations", F.array().cast(f"array<{CITATION}>")).alias("citations"), F.col("result.decision").alias("decision"), F.col("result.groundedness_score").alias("groundedness"), F.col("result.citation_coverage").alias("citation_coverage"), F.when(closed, F.col("final_latency")).alias("latency_ms"), F.when(closed, F.col("final_rewrites")).otherwise(F.col("guard_rewrites")).alias("rewrite_count"), "error", "activity")


def request_metrics(events: DataFrame) -> DataFrame:
    """STM2: by route: requests, candidates, retrieval and total latency, citations, rewrites and errors."""
    kind = F.col("type")
    per = events.groupBy("request_id").agg(
        F.max(F.when(kind == "route.selected", F.col("route"))).alias("route"), F.sum(F.when(kind == "retrieval.completed", F.col("candidate_count"))).alias("candidates"), F.sum(F.when(kind == "retrieval.completed", F.col("latency_ms"))).alias("retrieval_ms"),
        F.max(F.when(kind == "response.completed", F.col("latency_ms"))).alias("total_ms"), F.max(F.when(kind == "response.completed", F.col("citation_count"))).alias("citations"), F.max(F.when(kind.isin("guardrail.completed", "response.completed"), F.col("rewrite_count"))).alias("rewrites"), F.count_if(kind == "error").alias("errors"),
    )
    return per.groupBy("route").agg(F.count("*").alias("requests"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("candidates", "retrieval_ms", "total_ms", "citations", "rewrites", "errors")])


def error_counts(events: DataFrame) -> DataFrame:
    """STM2: errors by code."""
    return events.where(F.col("type") == "error").groupBy("code").agg(F.count("*").alias("errors"))


def jumps(ms: np.ndarray, limit: int, window_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted times of one key to allowed, remaining, reset_at: each window opens at the first time at or after the last one's end."""
    n = len(ms)
    count, reset = np.empty(n, np.int64), np.empty(n, np.int64)
    i = 0
    while i < n:
        end = int(np.searchsorted(ms, ms[i] + window_ms, side="left"))
        count[i:end], reset[i:end] = np.arange(1, end - i + 1), ms[i] + window_ms
        i = end
    return count <= limit, np.maximum(0, limit - count), reset


#: Rows of a key from which on it is cut into ranges of time of about as many.
HOT_ROWS = 1_000_000


def time_bounds(slim: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """hot_key, bounds: times that cut each key of more than hot_rows rows into ranges of about as many; there are few such keys."""
    counts = slim.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > hot_rows).withColumnRenamed(key, "hot_key")
    counts = staged(counts, "hot-keys")
    most = counts.agg(F.max("rows")).first()[0]
    if most is None:
        return counts.select("hot_key", F.array().cast("array<bigint>").alias("bounds"))
    cuts = -(-most // hot_rows)
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    own = slim.join(F.broadcast(counts), F.col(key).eqNullSafe(F.col("hot_key")))
    return staged(own.groupBy("hot_key").agg(F.array_distinct(F.percentile_approx("ms", shares, max(10_000, 20 * cuts))).alias("bounds")), "time-bounds")


def transition(ms: np.ndarray, window_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a range of sorted times does to the window that is open before it.

    Times up to which that window may last, and for each when the last window of the range then opens and how many times are in it. A
    window that lasts beyond the last of them has the whole range in it.
    """
    n = len(ms)
    follows = np.searchsorted(ms, ms + window_ms, side="left")
    last = np.where(follows < n, follows, np.arange(n))  # the window that opens next, or itself
    for _ in range(int(n).bit_length()):
        last = last[last]
    starts = np.arange(min(n, int(follows[0]) + 1))  # a window from before the first time ends in these at the latest
    keep = np.append(last[starts][1:] != last[starts][:-1], True)
    return ms[starts][keep], ms[last[starts]][keep], n - last[starts][keep]


def states_before(ranged: DataFrame, key: str, window_ms: int) -> DataFrame:
    """hot_key, hot_range, opened, used: the window that is open before each range of a hot key, by its ranges' transitions in turn."""
    kind = dict(ranged.dtypes)[key]

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        until, opened, used = transition(np.sort(rows["ms"].to_numpy()), window_ms)
        return pd.DataFrame({"hot_key": rows[key].iloc[:1], "hot_range": rows["range"].iloc[:1], "n": len(rows), "until": [until], "opened": [opened], "used": [used]})

    def chained(rows: pd.DataFrame) -> pd.DataFrame:
        opened, used, out = None, 0, []
        for r in rows.sort_values("hot_range").itertuples():
            out.append((r.hot_key, r.hot_range, opened, used))
            at = 0 if opened is None else int(np.searchsorted(r.until, opened + window_ms, side="left"))
            if at < len(r.until):
                opened, used = int(r.opened[at]), int(r.used[at])
            else:
                used += r.n
        return pd.DataFrame(out, columns=["hot_key", "hot_range", "opened", "used"]).astype({"opened": "Int64"})

    hot = ranged.where("hot").select(key, "range", "ms")
    parts = hot.groupBy(key, "range").applyInPandas(summed, f"hot_key {kind}, hot_range int, n long, until array<bigint>, opened array<bigint>, used array<bigint>")
    return parts.groupBy("hot_key").applyInPandas(chained, f"hot_key {kind}, hot_range int, opened long, used long")


def rate_limit(events: DataFrame, key: str, limit: int = LIMIT, window_ms: int = WINDOW_MS, ts: str = "ts", tie: str = "event_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """STM3: events with allowed, remaining, reset_at of a fixed window per key that opens with its first request.

    Keys are read from sorted partitions as a stream, so a key's rows are never held together. A key of more than hot_rows rows is cut into
    ranges of time for many tasks: each range is first reduced to what it does to an open window, these are applied one after the other,
    and then each range is counted on its own from the window that is open before it.
    """
    spread = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = events.select(key, tie, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    bounds = time_bounds(slim, key, hot_rows)
    ranged = slim.join(F.broadcast(bounds), F.col(key).eqNullSafe(F.col("hot_key")), "left")
    before = F.size(F.filter("bounds", lambda b: b < F.col("ms")))
    ranged = ranged.select(key, tie, "ms", F.col("bounds").isNotNull().alias("hot"), F.when(F.col("bounds").isNotNull(), before).otherwise(0).alias("range"))
    states = states_before(ranged, key, window_ms)
    same = F.col(key).eqNullSafe(F.col("hot_key")) & (F.col("range") == F.col("hot_range"))
    ready = ranged.join(F.broadcast(states), same, "left").select(key, tie, "ms", "range", "opened", F.coalesce("used", F.lit(0)).alias("used"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, opened, used = None, None, 0  # of the range that the last part ended in
        for part in parts:
            if not len(part):
                continue
            out = []
            for (k, span), rows in part.groupby([key, "range"], sort=False, dropna=False):
                ms = rows["ms"].to_numpy()
                k = None if pd.isna(k) else k
                if at != (k, span):
                    first = rows["opened"].iloc[0]
                    opened, used, at = None if pd.isna(first) else int(first), int(rows["used"].iloc[0]), (k, span)
                first, pieces = 0, []
                if opened is not None:
                    first = int(np.searchsorted(ms, opened + window_ms, side="left"))
                    c = used + np.arange(1, first + 1)
                    pieces.append((c <= limit, np.maximum(0, limit - c), np.full(first, opened + window_ms)))
                    used += first
                if first < len(ms):
                    allowed, remaining, reset = jumps(ms[first:], limit, window_ms)
                    pieces.append((allowed, remaining, reset))
                    opened, used = int(reset[-1]) - window_ms, int((reset == reset[-1]).sum())
                joined = {c: np.concatenate([p[i] for p in pieces]) for i, c in enumerate(("allowed", "remaining", "reset_ms"))}
                out.append(rows[[key, tie]].assign(**joined))
            yield pd.concat(out)

    kinds = dict(events.dtypes)
    ordered = ready.repartition(spread, key, "range").sortWithinPartitions(key, "range", "ms", tie)
    found = ordered.mapInPandas(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, allowed boolean, remaining long, reset_ms long")
    return found.withColumn("reset_at", F.timestamp_millis("reset_ms")).drop("reset_ms")


def consume_once(attempts: DataFrame, tie: str = "event_id") -> DataFrame:
    """STM4: attempts with `outcome`: the first before expires_at consumes; later ones are replays, others expired.

    attempts: object_path, ts, expires_at, and tie, which tells attempts of one time apart. A path's first attempt is an aggregate that is
    joined back: no task holds or sorts all attempts on a path.
    """
    fresh = F.col("ts") < F.col("expires_at")
    first = attempts.where(fresh).groupBy(F.col("object_path").alias("_path")).agg(F.min(F.struct("ts", tie)).alias("_first"))
    joined = attempts.join(first, F.col("object_path").eqNullSafe(F.col("_path")), "left")
    used = F.struct("ts", tie).eqNullSafe(F.col("_first"))
    return joined.withColumn("outcome", F.when(~fresh, "EXPIRED").when(used, "CONSUMED").otherwise("REPLAYED")).drop("_path", "_first")


def close_stale_requests(events: DataFrame, now: Column, timeout_s: int = TIMEOUT_SECONDS, code: str = "STREAM_TIMEOUT") -> DataFrame:
    """STM5: an error event, next in sequence, for each request without an end whose last event is older than the timeout."""
    per = events.groupBy("request_id").agg(F.max("sequence").alias("last"), F.max("ts").alias("ts"), F.count_if(F.col("type").isin(TERMINAL)).alias("ends"))
    stale = per.where((F.col("ends") == 0) & (F.unix_timestamp(now) - F.unix_timestamp("ts") > timeout_s))
    return stale.select("request_id", (F.col("last") + 1).alias("sequence"), F.lit("error").alias("type"), F.lit(code).alias("code"), F.timestamp_seconds(F.unix_timestamp("ts") + timeout_s).alias("ts"))
