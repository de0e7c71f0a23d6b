"""Stateful streams over request events. They need the RocksDB state store (see `use_rocksdb`).

The event time column is `ts`. State of a key is dropped `ttl_ms` after its last change. A lifetime makes the engine run on
without data, so a query that is to end by itself (availableNow) takes ttl_ms=None.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestrata.sources.keyed import KeyedStore
from lodestrata.streaming.events import CITATION, LABELS, LIMIT, PHASES, TERMINAL, TIMEOUT_SECONDS, WINDOW_MS

DAY_MS = 86_400_000
#: Events of a request that are kept with its head.
RECENT = 256
STATE = (
    f"request_id string, phase string, route string, answer string, citations array<{CITATION}>, decision string, groundedness double, citation_coverage double, "
    "latency_ms long, rewrite_count int, error string, activity array<string>, last_sequence int"
)


CITED = [c.split(":")[0].strip() for c in CITATION.removeprefix("struct<").split(",")]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def time_mode(ttl_ms: int | None) -> str:
    return "None" if ttl_ms is None else "ProcessingTime"


def phase(event: dict) -> str:
    """The phase that an event sets."""
    if event["type"] == "route.selected":
        return "Analyzing Data" if event.get("route") == "data_analytics" else "Routing"
    if event["type"].startswith("retrieval."):
        return "Searching Documents" if event.get("tool") == "document_search" else "Searching Video"
    return PHASES.get(event["type"], "")


class Fold:
    """A request's state from its events in any order, each taken in once and for itself.

    `head` keeps for each field the sequence that set it last. The answer is the last final response and the tokens behind it: tokens that
    come in order are appended, and only one that comes late has the answer put together again, from `events`. So with the activity.
    events: a map of sequence to (type, token) with get, put and items.
    """

    def __init__(self, head: dict | None, events):
        empty = {"last": 0, "set": {}, "final_at": None, "tokens": "", "token_at": 0, "activity": [], "label_at": 0}
        self.head, self.events = head or empty, events

    def _set(self, name: str, at: int, value) -> None:
        if at > self.head["set"].get(name, (0, None))[0]:
            self.head["set"][name] = (at, value)

    def _value(self, name: str):
        return self.head["set"].get(name, (0, None))[1]

    def take(self, event: dict) -> None:
        at, kind, head = event["sequence"], event["type"], self.head
        if at <= head["last"] and self.events.get(at) is not None:
            return  # the first of a sequence holds
        token = (event.get("token") or "") if kind == "generation.token" else None
        self.events.put(at, (kind, token))
        head["last"] = max(head["last"], at)
        if sets := phase(event):
            self._set("phase", at, sets)
        if kind == "route.selected":
            self._set("route", at, event.get("route"))
        elif kind == "error":
            self._set("error", at, event.get("message"))
        elif kind == "guardrail.completed":
            self._set("result", at, event.get("result") or {})
            self._set("guard_rewrites", at, event.get("rewrite_count"))
        elif kind == "response.completed":
            for name in ("final_response", "citations", "latency_ms", "rewrite_count"):
                self._set(name, at, event.get(name))
            if head["final_at"] is None or at > head["final_at"]:
                head["final_at"] = at
                if head["token_at"] > at:
                    self._join_tokens()
                else:
                    head["tokens"] = ""
        elif token is not None and at > (head["final_at"] or 0):
            if at > head["token_at"]:
                head["tokens"] += token
            else:
                self._join_tokens()
        if token is not None:
            head["token_at"] = max(head["token_at"], at)
        if kind in LABELS:
            if at > head["label_at"]:
                head["activity"].append(LABELS[kind])
                head["label_at"] = at
            else:
                head["activity"] = [LABELS[k] for _, (k, _) in sorted(self.events.items()) if k in LABELS]

    def _join_tokens(self) -> None:
        later = self.head["final_at"] or 0
        self.head["tokens"] = "".join(t for at, (_, t) in sorted(self.events.items()) if t is not None and at > later)

    def row(self) -> dict:
        head, result = self.head, self._value("result") or {}
        guarded = head["set"].get("result", (None,))[0]
        closed = guarded is not None and head["final_at"] is not None and head["final_at"] > guarded
        return {
            "phase": self._value("phase") or "Idle",
            "route": self._value("route"),
            "answer": (self._value("final_response") or "") + head["tokens"],
            "citations": [{k: c.get(k) for k in CITED} for c in self._value("citations") or []],
            "decision": result.get("decision"),
            "groundedness": result.get("groundedness_score"),
            "citation_coverage": result.get("citation_coverage"),
            "latency_ms": self._value("latency_ms") if closed else None,
            "rewrite_count": self._value("rewrite_count") if closed else self._value("guard_rewrites"),
            "error": self._value("error"),
            "activity": head["activity"],
            "last_sequence": head["last"],
        }


class Held(dict):
    """Events in memory."""

    put = dict.__setitem__


def fold(events: list[dict]) -> dict:
    """The state after events in any order."""
    own = Fold(None, Held())
    for e in events:
        own.take(e)
    return own.row()


class KeptEvents:
    """A request's events: those that came last, kept with its head, and a map state of the ones before.

    Each call of a state costs milliseconds, so events go to the map only once RECENT of them are together.
    """

    def __init__(self, state, recent: list, moved: bool):
        self.state, self.moved = state, moved  # moved: whether the map holds any
        self.recent = {at: tuple(event) for at, event in recent}

    def get(self, at: int):
        if (event := self.recent.get(at)) is not None or not self.moved:
            return event
        return self.state.getValue((at,)) if self.state.containsKey((at,)) else None

    def put(self, at: int, event: tuple) -> None:
        self.recent[at] = event
        if len(self.recent) > RECENT:
            for own, kept in self.recent.items():
                self.state.updateValue((own,), kept)
            self.recent, self.moved = {}, True

    def items(self) -> Iterator[tuple[int, tuple]]:
        if self.moved:
            yield from ((int(k[0]), tuple(v)) for k, v in self.state.iterator())
        yield from self.recent.items()


class RequestFold(StatefulProcessor):
    """Keeps what a request's events come to, with the last of them, in one value, which an arrival reads and writes once; earlier ones in a map by sequence."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", "body string", self.ttl_ms)
        self.events = handle.getMapState("events", "sequence int", "type string, token string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.head.get()
        head, recent, moved = json.loads(held[0]) if held else (None, [], False)
        own = Fold(head, KeptEvents(self.events, recent, moved))
        for row in rows:
            own.take(json.loads(row["body"]))
        self.head.update((json.dumps([own.head, list(own.events.recent.items()), own.events.moved]),))
        yield Row(request_id=key[0], **own.row())

    def close(self) -> None:
        pass


def fold_requests_stream(events: DataFrame, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """STM1: each request's state, all fields of fold_requests, whenever events of it arrive, in any order.

    events: request_id, sequence, type and fields. Of several events of one sequence the one that arrives first holds.
    """
    body = events.select("request_id", F.to_json(F.struct(*[c for c in events.columns if c != "ts"])).alias("body"))
    return body.groupBy("request_id").transformWithState(RequestFold(ttl_ms), STATE, "Update", time_mode(ttl_ms))


class Limiter(StatefulProcessor):
    def __init__(self, limit: int, window_ms: int, ttl_ms: int | None):
        self.limit, self.window_ms, self.ttl_ms = limit, window_ms, ttl_ms

    def init(self, handle) -> None:
        self.window = handle.getValueState("window", "reset_ms long, used long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reset, used = map(int, self.window.get()) if self.window.exists() else (None, 0)
        found = []
        for tie, ms in pd.concat(list(rows)).sort_values(["ms", "tie"])[["tie", "ms"]].itertuples(index=False):
            if reset is None or reset <= ms:
                reset, used = int(ms) + self.window_ms, 0
            used += 1
            found.append((str(key[0]), int(tie), used <= self.limit, max(0, self.limit - used), reset))
        self.window.update((reset, used))
        yield pd.DataFrame(found, columns=["key", "tie", "allowed", "remaining", "reset_ms"])

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, key: str, limit: int = LIMIT, window_ms: int = WINDOW_MS, ts: str = "ts", tie: str = "event_id", ttl_ms: int | None = DAY_MS) -> DataFrame:
    """STM3: key, tie, allowed, remaining, reset_ms for each event; within a micro-batch by time."""
    slim = events.select(F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias("tie"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return slim.groupBy("key").transformWithStateInPandas(Limiter(limit, window_ms, ttl_ms), "key string, tie long, allowed boolean, remaining long, reset_ms long", "Append", time_mode(ttl_ms))


class StaleRequests(StatefulProcessor):
    """The last event of a request until it ends, then a mark that it ended, which goes when nothing of it can be in time any more."""

    def __init__(self, timeout_s: int, grace_s: int, code: str):
        self.timeout_ms, self.grace_ms, self.code = timeout_s * 1000, grace_s * 1000, code

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence int, ms long, ended boolean, due long")

    def _keep(self, seq: int, ms: int, ended: bool, due: int | None) -> None:
        """Hold the state, and have the timer at the time that is now due."""
        at = ms + (self.grace_ms if ended else self.timeout_ms)
        if due != at:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
        self.last.update((seq, ms, ended, at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, ms, ended, due = self.last.get() if self.last.exists() else (0, 0, False, None)
        for part in rows:
            seq, ms = max(int(seq), int(part["sequence"].max())), max(int(ms), int(part["ms"].max()))
            ended = bool(ended) or bool(part["type"].isin(TERMINAL).any())
        self._keep(int(seq), int(ms), bool(ended), None if due is None else int(due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        seq, ms, ended, due = self.last.get()
        if expiredTimerInfo.getExpiryTimeInMs() != int(due):
            return
        if ended:
            self.last.clear()
            return
        self._keep(int(seq) + 1, int(due), True, None)
        yield pd.DataFrame([{"request_id": key[0], "sequence": int(seq) + 1, "type": "error", "code": self.code}])

    def close(self) -> None:
        pass


def close_stale_stream(events: DataFrame, timeout_s: int = TIMEOUT_SECONDS, code: str = "STREAM_TIMEOUT", delay: str = "10 seconds", grace_s: int = 600) -> DataFrame:
    """STM5: an error event for each request without an end once event time has passed its last event by the timeout.

    A request that ended, by itself or so, is remembered for grace_s of event time after its last event; later events of it give no second
    error in that time. Then its state is dropped.
    """
    slim = events.select("request_id", "sequence", "type", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", delay)
    return slim.groupBy("request_id").transformWithStateInPandas(StaleRequests(timeout_s, grace_s, code), "request_id string, sequence int, type string, code string", "Append", "EventTime")


COUNTED = ["candidates", "retrieval_ms", "total_ms", "citations", "rewrites", "errors"]
TOTALS = pa.schema([("request_id", pa.string()), ("route", pa.string()), *[(c, pa.int64()) for c in COUNTED], ("ms", pa.int64())])
#: How totals of one request come together; of a batch's events candidates and retrieval_ms are summed up as doubles first.
TOGETHER = [("route", "max"), ("candidates", "sum"), ("retrieval_ms", "sum"), ("total_ms", "max"), ("citations", "max"), ("rewrites", "max"), ("errors", "sum")]


def totals(rows: pa.Table) -> pa.Table:
    """One row a request."""
    return rows.group_by("request_id", use_threads=False).aggregate([*TOGETHER, ("ms", "max")]).rename_columns(TOTALS.names)


def metric_changes(new: pa.Table, old: pa.Table) -> pa.Table:
    """By route, what the requests of new add and those of old take back; routes without a change are left out."""
    parts = [t.select(["route", *COUNTED]).append_column("requests", pa.array(np.full(len(t), 1))) for t in (new, old)]
    for c in ("requests", *COUNTED):
        parts[1] = parts[1].set_column(parts[1].schema.get_field_index(c), c, pc.negate(parts[1][c]))
    sums = pa.concat_tables(parts).group_by("route", use_threads=False).aggregate([(c, "sum") for c in ("requests", *COUNTED)])
    sums = sums.rename_columns(["route", "requests", *COUNTED])
    return sums.filter(functools.reduce(pc.or_, [pc.not_equal(sums[c], 0) for c in ("requests", *COUNTED)]))


def fold_totals(ttl_ms: int | None) -> Callable:
    """For applyInPandasWithState: what the requests of a bucket add to the metrics, kept as one Arrow table."""
    events = pa.schema([f if f.name not in ("candidates", "retrieval_ms") else f.with_type(pa.float64()) for f in TOTALS])

    def run(key, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = 0 if ttl_ms is None else held.getCurrentProcessingTimeMs()
        old = pa.ipc.open_stream(bytes(held.get[0])).read_all() if held.exists else TOTALS.empty_table()
        if ttl_ms is not None:
            old = old.filter(pc.greater(old["ms"], now - ttl_ms))
        table = lambda p: pa.table([pa.array(p[f.name].to_numpy() if f.name != "ms" else np.full(len(p), now), f.type, from_pandas=True) for f in events], events)
        found = [totals(table(p)) for p in parts]
        fresh = totals(pa.concat_tables(found))
        for c in ("candidates", "retrieval_ms"):
            fresh = fresh.set_column(fresh.schema.get_field_index(c), c, pc.cast(pc.trunc(fresh[c]), pa.int64()))
        new = totals(pa.concat_tables([old, fresh.cast(TOTALS)])).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, TOTALS) as out:
            out.write_table(new)
        held.update((sink.getvalue().to_pybytes(),))
        if ttl_ms is not None:
            held.setTimeoutDuration(ttl_ms)
        yield metric_changes(new, old).to_pandas()

    return run


def request_metrics_stream(events: DataFrame, ttl_ms: int | None = DAY_MS, buckets: int = 2048) -> DataFrame:
    """STM2: signed changes of the metrics by route; their sums by route are at any time what request_metrics gives for the events so far.

    Numbers of events are not negative. A request of which nothing came for ttl_ms counts as another one if it goes on.
    Requests lie in buckets by a hash of their id. A bucket comes to its task with its rows and is worked on as a whole, so calls are
    as many as buckets, not requests; a bucket that gets an event is written again. A stream's number of buckets must not change.
    """
    number = lambda c, *kinds: F.when(F.col("type").isin(*kinds), F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    whole = lambda c, *kinds: F.greatest(number(c, *kinds).cast("long"), F.lit(0))
    slim = events.select(
        F.pmod(F.xxhash64("request_id"), F.lit(buckets)).alias("bucket"), F.col("request_id").cast("string").alias("request_id"), F.when(F.col("type") == "route.selected", F.col("route")).alias("route"),
        number("candidate_count", "retrieval.completed").alias("candidates"), number("latency_ms", "retrieval.completed").alias("retrieval_ms"),
        whole("latency_ms", TERMINAL[0]).alias("total_ms"), whole("citation_count", TERMINAL[0]).alias("citations"), whole("rewrite_count", "guardrail.completed", TERMINAL[0]).alias("rewrites"),
        F.when(F.col("type") == "error", 1).otherwise(0).cast("long").alias("errors"),
    )
    schema = "route string, requests long, " + ", ".join(f"{c} long" for c in COUNTED)
    timeout = "NoTimeout" if ttl_ms is None else "ProcessingTimeTimeout"
    return slim.groupBy("bucket").applyInPandasWithState(fold_totals(ttl_ms), schema, "body binary", "append", timeout)


def route_totals(changes: DataFrame) -> DataFrame:
    """The metrics by route from the changes that request_metrics_stream has given."""
    sums = changes.groupBy("route").agg(*[F.sum(c).alias(c) for c in ("requests", *COUNTED)])
    return sums.where("requests != 0")


def error_counts_stream(events: DataFrame, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """STM2: errors by window and code."""
    return events.withWatermark("ts", delay).where("type = 'error'").groupBy(F.window("ts", size), "code").agg(F.count("*").alias("errors"))


class OnceUsed(StatefulProcessor):
    """Keeps a path that was used until no attempt on it can be in time any more."""

    def __init__(self, columns: list[str], tie: str | None):
        self.columns, self.order = columns, ["_ms", tie] if tie else ["_ms"]

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts = pd.concat(list(rows)).set_axis([*self.columns, "_ms", "_until"], axis=1).sort_values(self.order, kind="stable")
        used = self.until.exists()
        before, until = int(self.until.get()[0]) if used else None, int(attempts["_until"].max())
        if before is None or until > before:
            if used:
                self.handle.deleteTimer(before)
            self.until.update((until,))
            self.handle.registerTimer(until)
        return iter([] if used else [attempts.iloc[:1].drop(columns=["_ms", "_until"])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def consume_once_stream(attempts: DataFrame, delay: str = "1 hour", tie: str | None = None) -> DataFrame:
    """STM4: the first attempt on each object_path that is in time; replays are dropped, however long after the first.

    A path is kept until event time less the delay has passed the last expires_at seen for it. Of one micro-batch's attempts
    the earliest counts, equal ones by `tie`. Rows later than the delay are dropped.
    """
    timed = attempts.withWatermark("ts", delay).where("ts < expires_at")
    timed = timed.select(*attempts.columns, F.unix_millis(F.col("ts").cast("timestamp")).alias("_ms"), (F.unix_millis(F.col("expires_at").cast("timestamp")) + 1).alias("_until"))
    return timed.groupBy("object_path").transformWithStateInPandas(OnceUsed(attempts.columns, tie), attempts.schema, "Append", "EventTime")


def ingest_stream(pages: DataFrame, store: KeyedStore, build: Callable[[DataFrame], DataFrame], checkpoint: str):
    """STM6: a query that turns new pages into records by `build` and adds those that the store lacks.

    A micro-batch is a batch of the store under the stream's checkpoint and its number: run again it adds nothing twice.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, number: int) -> None:
        store.add(f"{name}-{number:09}", build(df))

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
