import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import analytics
from lodestrata.plans import logs
from lodestrata.sources import keyed, store
from lodestrata.sources.files import admit_files
from lodestrata.sources.tables import read_eval_cases
from lodestrata.streaming import events as ev
from lodestrata.streaming import state as st

LOG = [
    {"sequence": 1, "type": "request.started", "thread_id": "t"}, {"sequence": 2, "type": "route.selected", "route": "document_search"}, {"sequence": 3, "type": "retrieval.started", "tool": "document_search"},
    {"sequence": 4, "type": "retrieval.completed", "tool": "document_search", "candidate_count": 3, "latency_ms": 9}, {"sequence": 5, "type": "generation.started", "route": "document_search"}, {"sequence": 6, "type": "generation.token", "token": "Grounded ", "index": 0},
    {"sequence": 7, "type": "guardrail.completed", "result": {"decision": "approve", "groundedness_score": 0.95, "citation_coverage": 1.0, "schema_valid": True}, "rewrite_count": 0},
    {"sequence": 8, "type": "response.completed", "final_response": "Grounded answer.", "citations": [], "citation_count": 0, "latency_ms": 41, "rewrite_count": 0},
]
PHASES = ["Thinking", "Routing", "Searching Documents", "Searching Documents", "Synthesizing", "Synthesizing", "Validating", "Complete"]


def lines(rows, rid="r"):
    return [json.dumps({"schema_version": "1.0", "request_id": rid, "correlation_id": "c"} | r) for r in rows]


def parsed(spark, rows):
    return spark.createDataFrame([(x, None, None) for x in rows], "value string, frame_id string, frame_type string").withColumn("event", F.from_json("value", ev.EVENT))


def table_of(spark, rows):
    return parsed(spark, rows).select("event.*").withColumn("ts", F.timestamp_seconds(F.col("sequence")))


def test_state_after_each_prefix(spark):
    for n in range(1, 9):
        assert ev.fold_requests(table_of(spark, lines(LOG[:n]))).head().phase == PHASES[n - 1]
    done = ev.fold_requests(table_of(spark, lines(LOG[::-1]))).head()
    assert (done.answer, done.groundedness, done.latency_ms, done.route, len(done.activity)) == ("Grounded answer.", 0.95, 41, "document_search", 7)
    assert st.fold([json.loads(x) for x in lines(LOG)])["answer"] == "Grounded answer."
    part = ev.fold_requests(table_of(spark, lines(LOG[:6]))).head()
    assert part.answer == "Grounded " and part.latency_ms is None


def test_sequences(spark):
    rows = lines(LOG, "good") + lines(LOG[:3], "open") + lines([LOG[0], LOG[3]], "gap") + lines([LOG[7] | {"sequence": 1}, LOG[0] | {"sequence": 2}], "late")
    got = {r.request_id: r.valid for r in ev.check_sequences(table_of(spark, rows)).collect()}
    assert got == {"good": True, "open": False, "gap": False, "late": False}
    assert ev.distinct_events(table_of(spark, lines(LOG + LOG))).count() == 8


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"type": "nope"}, "UNKNOWN_TYPE"), ({"sequence": 0}, "BAD_ENVELOPE"), ({"latency_ms": -1}, "BAD_FIELDS"), ({"citation_count": 2}, "CITATION_COUNT_MISMATCH"), ({"final_response": ""}, "BAD_FIELDS"),
    ({"citations": [{"source_type": "video", "start_seconds": 2, "end_seconds": 1}], "citation_count": 1}, "BAD_CITATION_TIMES"),
])
def test_validation(spark, change, reason):
    assert ev.validate_events(parsed(spark, lines([LOG[7] | change]))).head().reason == reason


def test_frames(spark, tmp_path):
    body = lines(LOG[:2])
    (tmp_path / "log.txt").write_text(f": ping\n\nid: 1\nevent: request.started\ndata: {body[0]}\n\nid: 2\nevent: error\ndata: {body[1]}\n\n")
    got = ev.validate_events(ev.read_event_log(spark, str(tmp_path / "log.txt"), frames=True)).orderBy("frame_id").collect()
    assert [(r.frame_id, r.reason) for r in got] == [("1", None), ("2", "FRAME_MISMATCH")]
    two = spark.createDataFrame([('data: {"a":\ndata: 1}',)], "value string")
    assert ev.parse_sse_frames(two).head().value == '{"a":\n1}'


def test_metrics_by_route(spark):
    m = ev.request_metrics(table_of(spark, lines(LOG, "a") + lines(LOG, "b"))).head()
    assert (m.route, m.requests, m.candidates, m.retrieval_ms, m.total_ms) == ("document_search", 2, 6, 18, 82)
    bad = lines([{"sequence": 1, "type": "error", "code": "STREAM_FAILED", "message": "x", "retryable": True}])
    assert [tuple(r) for r in ev.error_counts(table_of(spark, bad)).collect()] == [("STREAM_FAILED", 1)]


def limited(times, limit, window):
    out, reset, used = [], None, 0
    for t in times:
        if reset is None or reset <= t:
            reset, used = t + window, 0
        used += 1
        out.append((used <= limit, max(0, limit - used), reset))
    return out


def test_limiter_by_hand_and_by_brute_force(spark):
    a, r, at = ev.jumps(np.array([0, 10_000, 20_000, 59_999, 60_000, 61_000]), 2, 60_000)
    assert a.tolist() == [True, True, False, False, True, True] and r.tolist() == [1, 0, 0, 0, 1, 0] and at.tolist() == [60_000] * 4 + [120_000] * 2
    rng = np.random.default_rng(4)
    rows = [(int(k), i, int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 500_000, 400), strict=True))]
    want = {}
    for key in range(3):
        own = sorted((t, i) for k, i, t in rows if k == key)
        want |= dict(zip([i for _, i in own], limited([t for t, _ in own], 3, 60_000), strict=True))
    df = spark.createDataFrame(rows, "k int, event_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    for batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {x.event_id: (x.allowed, x.remaining, x.reset) for x in ev.rate_limit(df, "k", 3).withColumn("reset", F.unix_millis("reset_at")).collect()}
        assert got == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_time_use(spark):
    rows = [(1, "p", 1, 10), (2, "p", 2, 10), (3, "q", 11, 10), (4, "r", 9, 10)]
    df = spark.createDataFrame(rows, "event_id int, object_path string, t int, e int").select("event_id", "object_path", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("e").alias("expires_at"))
    assert [r.outcome for r in ev.consume_once(df).orderBy("event_id").collect()] == ["CONSUMED", "REPLAYED", "EXPIRED", "CONSUMED"]


def test_stale_requests_get_an_end(spark):
    got = ev.close_stale_requests(table_of(spark, lines(LOG[:3], "open") + lines(LOG, "done")), F.timestamp_seconds(F.lit(500))).collect()
    assert [(r.request_id, r.sequence, r.code) for r in got] == [("open", 4, "STREAM_TIMEOUT")]


def streamed(spark, tmp_path, df, build, mode):
    st.use_rocksdb(spark)
    src = str(tmp_path / "in")
    df.repartition(1).write.parquet(src)
    name = f"t{abs(hash(src))}"
    q = build(spark.readStream.schema(df.schema).parquet(src)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return spark.table(name)


def test_streamed_fold_equals_the_table(spark, tmp_path):
    df = table_of(spark, lines(LOG[::-1], "a") + lines(LOG[:6], "b"))
    columns = [c for c in ev.fold_requests(df).columns if c != "request_id"]
    got = {r.request_id: [r[c] for c in columns] for r in streamed(spark, tmp_path, df, lambda s: st.fold_requests_stream(s, None), "update").collect()}
    want = {r.request_id: [r[c] for c in columns] for r in ev.fold_requests(df).collect()}
    assert got == want and len(got) == 2


def folded(events):
    """The state after events in order of sequence, all of them read."""
    out = {"phase": "Idle", "route": None, "answer": "", "citations": [], "result": {}, "latency_ms": None, "error": None, "activity": [], "final_at": 0, "guard_at": 0, "guard_rewrites": None, "rewrite_count": None}
    for e in sorted(events, key=lambda e: e["sequence"]):
        kind = e["type"]
        out["phase"] = st.phase(e) or out["phase"]
        out["activity"] = out["activity"] + [ev.LABELS[k] for k in [kind] if k in ev.LABELS]
        if kind == "route.selected":
            out["route"] = e.get("route")
        elif kind == "error":
            out["error"] = e.get("message")
        elif kind == "generation.token":
            out["answer"] += e["token"]
        elif kind == "guardrail.completed":
            out |= {"result": e["result"], "guard_rewrites": e["rewrite_count"], "guard_at": e["sequence"]}
        elif kind == "response.completed":
            out |= {"answer": e["final_response"], "latency_ms": e["latency_ms"], "rewrite_count": e["rewrite_count"], "final_at": e["sequence"]}
    closed = 0 < out["guard_at"] < out["final_at"]
    return (out["phase"], out["route"], out["answer"], out["result"].get("decision"), out["latency_ms"] if closed else None, out["rewrite_count"] if closed else out["guard_rewrites"], out["error"], out["activity"])


def test_folds_of_every_prefix_in_any_order():
    rng = random.Random(9)
    kinds = ["request.started", "route.selected", "retrieval.completed", "generation.token", "generation.token", "generation.token", "guardrail.completed", "response.completed", "error"]
    for _ in range(150):
        events = [{"sequence": i, "type": rng.choice(kinds), "route": rng.choice(ev.ROUTES), "tool": rng.choice(ev.TOOLS), "token": f"t{i} ", "result": {"decision": f"d{i}"}, "rewrite_count": i % 2, "final_response": f"final {i}. ", "latency_ms": i, "message": f"m{i}"} for i in range(1, 15)]
        arrivals = events[:]
        rng.shuffle(arrivals)
        own = st.Fold(None, st.Held())
        for n, e in enumerate(arrivals, 1):
            own.take(e)
            own.take(e | {"type": "error", "message": "a second event of the sequence"})
            own.head = json.loads(json.dumps(own.head))  # as it is kept between batches
            row = own.row()
            assert tuple(row[c] for c in ("phase", "route", "answer", "decision", "latency_ms", "rewrite_count", "error", "activity")) == folded(arrivals[:n])


def test_streamed_metrics_are_those_of_the_table_after_each_batch(spark, tmp_path):
    st.use_rocksdb(spark)
    src, rng = str(tmp_path / "in"), random.Random(3)
    kinds = ["route.selected", "retrieval.completed", "guardrail.completed", "response.completed", "error"]
    schema = "request_id string, sequence int, type string, route string, candidate_count int, latency_ms int, citation_count int, rewrite_count int, code string, ts timestamp"
    rows = [(f"r{rng.randint(0, 4)}", i, rng.choice(kinds), rng.choice(ev.ROUTES), rng.choice([None, i]), i, i % 5, i % 2, rng.choice(ev.ERROR_CODES), None) for i in range(60)]
    for at in range(0, 60, 20):
        spark.createDataFrame(rows[at : at + 20], schema).withColumn("ts", F.timestamp_seconds("sequence")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    changes = logs.run_stream(st.request_metrics_stream(stream, None), "append")
    for batch in range(3):
        table = lambda df: {r.route: tuple(r[c] for c in ("requests", *st.COUNTED)) for r in df.collect()}
        so_far = spark.createDataFrame(rows[: 20 * batch + 20], schema)
        assert table(st.route_totals(changes.where(f"batch <= {batch}"))) == table(ev.request_metrics(so_far))


def test_streamed_metrics_work_by_bucket_not_by_request(spark, tmp_path):
    st.use_rocksdb(spark)
    src = str(tmp_path / "in")
    rows = spark.range(6000).select(F.concat(F.lit("r"), F.col("id") % 2000).alias("request_id"), F.lit("route.selected").alias("type"), F.element_at(F.array(*map(F.lit, ev.ROUTES)), (F.col("id") % 3 + 1).cast("int")).alias("route"), *[F.lit(1).alias(c) for c in ("candidate_count", "latency_ms", "citation_count", "rewrite_count")])
    rows.unionByName(rows.limit(40).withColumn("request_id", F.lit(None).cast("string"))).repartition(2).write.parquet(src)
    changes = logs.run_stream(st.request_metrics_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src), None, buckets=16), "append")
    assert changes.where("batch = 0").count() <= 16 * 4 and changes.where("batch = 1").count() <= 16 * 4
    assert {r.route: r.requests for r in st.route_totals(changes).collect()} == {r.route: r.requests for r in ev.request_metrics(spark.read.parquet(src)).collect()}


class HeldBucket:
    def __init__(self):
        self.exists, self.hasTimedOut, self.now = False, False, 0

    def update(self, value):
        self.get, self.exists = value, True

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms


def test_a_request_without_events_for_its_lifetime_counts_anew():
    held, run = HeldBucket(), st.fold_totals(100)
    turns = [(0, ["a", "b"]), (60, ["a"]), (120, ["a", "b"])]  # a goes on, b is forgotten at 100
    found = []
    for held.now, ids in turns:
        n = len(ids)
        part = pd.DataFrame({"bucket": [0] * n, "request_id": ids, "route": ["x"] * n, "candidates": [1.5] * n, "retrieval_ms": [0.0] * n, "total_ms": [held.now] * n, "citations": [0] * n, "rewrites": [0] * n, "errors": [1] * n})
        found.append(pd.concat(run((0,), iter([part, part]), held))[["requests", "candidates", "total_ms", "errors"]].to_numpy().tolist())
    assert found == [[[2, 6, 0, 4]], [[0, 3, 60, 2]], [[1, 6, 180, 4]]] and held.due == 220


def test_streamed_limiter_equals_the_table(spark, tmp_path):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 10, 20, 59, 60, 61])], "k string, event_id long, s long").select("k", "event_id", F.timestamp_seconds("s").alias("ts"))
    got = {(r.key, r.tie): (r.allowed, r.remaining, r.reset_ms) for r in streamed(spark, tmp_path, df, lambda s: st.rate_limit_stream(s, "k", 2, ttl_ms=None), "append").collect()}
    want = {(r.k, r.event_id): (r.allowed, r.remaining, r.reset) for r in ev.rate_limit(df, "k", 2).withColumn("reset", F.unix_millis("reset_at")).collect()}
    assert got == want


def test_streamed_timeouts_and_what_is_left_of_them(spark, tmp_path):
    st.use_rocksdb(spark)
    src = str(tmp_path / "in")
    # open stops without an end, done ends; both have late events while they are remembered, and nothing is kept in the end
    turns = [[("open", 1, "request.started", 10), ("done", 1, "request.started", 10), ("done", 2, "error", 11)], [("x", 1, "error", 300)], [("x", 2, "error", 310)]]
    turns += [[("open", 2, "route.selected", 311), ("done", 3, "route.selected", 311)], [("y", 1, "error", 700)], [("z", 1, "error", 5000)], [("z", 2, "error", 9000)], [("z", 3, "error", 20000)]]
    schema = "request_id string, sequence int, type string, t long"
    for turn in turns:
        spark.createDataFrame(turn, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("request_id string, sequence int, type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    found = st.close_stale_stream(stream, timeout_s=120, delay="10 seconds", grace_s=600)
    q = found.writeStream.outputMode("append").format("memory").queryName("stale").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert [tuple(r) for r in spark.table("stale").collect()] == [("open", 2, "error", "STREAM_TIMEOUT")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # z at most, with its timer


@pytest.mark.parametrize("window", [7, 40, 100_000])
def test_a_hot_key_is_cut_and_counts_as_one(spark, window):
    rng = np.random.default_rng(window)
    times = np.sort(rng.integers(0, 900, 700)).tolist()
    rows = [("hot", i, t) for i, t in enumerate(times)] + [(rng.choice(["a", "b"]).item(), 1000 + i, int(t)) for i, t in enumerate(rng.integers(0, 900, 60))] + [(None, 2000 + i, i) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, event_id long, ms long").select("k", "event_id", F.timestamp_millis("ms").alias("ts"))
    got = {(r.k, r.event_id): (r.allowed, r.remaining, r.reset) for r in ev.rate_limit(df, "k", 3, window, hot_rows=50).withColumn("reset", F.unix_millis("reset_at")).collect()}
    want, open_ = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        reset, used = open_.get(k, (None, 0))
        reset, used = (t + window, 1) if reset is None or reset <= t else (reset, used + 1)
        open_[k] = reset, used
        want[k, i] = (used <= 3, max(0, 3 - used), reset)
    assert got == want
    slim = df.select("k", F.unix_millis("ts").alias("ms"))
    assert {r.hot_key: len(r.bounds) >= 1 for r in ev.time_bounds(slim, "k", 50).collect()} == {"hot": True, None: True}


def test_streamed_one_time_use_lasts_until_expiry(spark, tmp_path):
    st.use_rocksdb(spark)
    src = str(tmp_path / "in")
    # p is used, event time moves on by hours, p is tried again while in time, with a later limit too; after that limit it is forgotten
    turns = [[(1, "p", 100, 20000), (2, "p", 90, 20000), (3, "q", 99, 99)], [(4, "r1", 10000, 10001)], [(5, "p", 15000, 30000), (6, "s", 15000, 40000)], [(7, "r2", 24500, 24501)], [(8, "p", 25000, 30000)], [(9, "r3", 40000, 40001)], [(10, "r4", 41000, 41001)], [(11, "p", 42000, 50000), (12, "s", 39000, 40000)]]
    for turn in turns:
        df = spark.createDataFrame(turn, "event_id int, object_path string, t int, e int").select("event_id", "object_path", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("e").alias("expires_at"))
        df.coalesce(1).write.mode("append").parquet(src)
    stream = st.consume_once_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), tie="event_id")
    q = stream.writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("once").orderBy("event_id").collect()
    assert [r.event_id for r in got] == [2, 4, 6, 7, 9, 10, 11] and got[0].ts.timestamp() == 90


def test_ingestion_adds_each_record_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "record_id string, n int")
    for turn in (1, 2):
        df.coalesce(1).write.mode("append").parquet(src)
        held = keyed.KeyedStore(spark, out)
        st.ingest_stream(spark.readStream.schema(df.schema).parquet(src), held, lambda d: d, str(tmp_path / f"cp{turn}")).awaitTermination(60)
    assert sorted(r.record_id for r in held.records().collect()) == ["a", "b"] and len(held.batches()) == 2


def test_a_batch_reads_its_buckets_only_and_runs_again_cleanly(spark, tmp_path):
    out = keyed.KeyedStore(spark, str(tmp_path / "out"), buckets=64, bits=1 << 20)
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("record_id"), "id")
    read = [out.add(f"b{i}", rows(2000 * i, 2000 * i + 2000)) for i in range(3)]
    assert max(read) < 200  # new keys are not compared with the stored ones, however many these are
    assert 0 < out.add("b3", rows(5990, 6010)) < 1500 and out.records().count() == 6010
    assert out.add("b3", rows(0, 9000)) == 0 and out.records().count() == 6010  # it counts already
    (tmp_path / "out/filters/batch=b3/_SUCCESS").unlink()  # as if the batch had broken off
    assert out.records().count() == 6000
    out.add("b3", rows(5990, 6010))
    assert out.records().count() == out.records().distinct().count() == 6010


def test_a_run_twice_at_once_is_refused(spark, tmp_path):
    with pytest.raises(store.DuplicateRecord):
        store.append_summary(spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, created_at int"), str(tmp_path / "runs"))


def test_store_refuses_known_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    one = spark.createDataFrame([("c1", "d", [0.1, 0.2, 0.3])], "record_id string, owner_id string, embedding array<double>")
    store.write_records(one, path, "chunk")
    assert store.read_records(spark, path, "chunk").head().embedding == [0.1, 0.2, 0.3]
    for bad in (one, one.withColumn("record_id", F.lit("c2")).union(one.withColumn("record_id", F.lit("c2")))):
        with pytest.raises(store.DuplicateRecord):
            store.write_records(bad, path, "chunk")
    store.write_records(one, path, "segment")
    run = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, created_at int")
    store.append_summary(run, str(tmp_path / "runs"))
    with pytest.raises(store.DuplicateRecord):
        store.append_summary(run.limit(1), str(tmp_path / "runs"))
    assert [r.run_id for r in store.recent_summaries(spark.read.parquet(str(tmp_path / "runs")), 1).collect()] == ["r2"]


def test_index_upkeep(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "k string"), spark.createDataFrame([("2",), ("3",)], "k string")
    assert tuple(store.reconcile(a, b, "k").head()) == (2, 2, 1, 1, "rebuild") and store.reconcile(a, a, "k").head().verdict == "equal"
    add, drop = store.difference(a, b, "k")
    assert [r.k for r in add.collect()] == ["1"] and [r.k for r in drop.collect()] == ["3"]
    assert [r.k for r in store.get_by_ids(a, ["2", "9", "1"], "k").collect()] == ["2", "1"]
    assert [r.k for r in store.delete_owners(a, b, "k").collect()] == ["1"]
    assert store.results_match(a, a).head().matches and not store.results_match(a, a.union(a)).head().matches


def test_catalogue_and_charts(spark):
    f = lambda x: spark.createDataFrame([x], "id string, filename string")
    assert store.catalogue(f(("1", "a")), f(("2", "b")), f(("3", "c")), "video").head().id == "2"
    c = spark.createDataFrame([("x", 1.0), ("<b>", float("nan"))], "l string, v double")
    got = store.check_chart_rows(c, "l", "v").head()
    assert (got.bad_values, got.bad_labels, got.valid) == (1, 1, False) and store.check_chart_rows(c.limit(1), "l", "v").head().valid and not store.check_chart_rows(c, "l", "l").head().valid


def test_admission(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    (tmp_path / "d.pdf").write_bytes(b"")
    got = {r.filename: r.reason for r in admit_files(spark, str(tmp_path), "pdf", 100).collect()}
    assert got == {"a.pdf": None, "b.pdf": "BAD_SIGNATURE", "c.txt": "UNSUPPORTED_EXTENSION", "d.pdf": "EMPTY_FILE"}
    (tmp_path / "v.mp4").write_bytes(b"\0\0\0\x18ftypmp42")
    assert admit_files(spark, str(tmp_path / "v.mp4"), "mp4", 10).head().reason == "FILE_TOO_LARGE" and admit_files(spark, str(tmp_path / "v.mp4"), "mp4", 100).head().reason is None


def test_evaluation_cases(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"schema_version": "1", "dataset_id": "x", "cases": [{"case_id": "1", "query": "q", "relevant_document": "f", "relevant_page": 2, "relevant_chunk_index": 1}]}))
    assert read_eval_cases(spark, str(tmp_path / "e.json"), "cases").head().relevant_page == 2


def test_checksums_of_datasets_do_not_depend_on_order(spark):
    cases = spark.createDataFrame([("d", "routing", f"c{i}", f"question {i}") for i in range(300)] + [("e", "routing", "c1", None)], "dataset_id string, kind string, case_id string, query string")
    assets = spark.createDataFrame([("d", "a.pdf", "0a"), ("d", "b.pdf", "0b"), ("f", "c.pdf", "0c")], "dataset_id string, path string, checksum string")
    of = lambda c, a: {r.dataset_id: r.checksum for r in text.dataset_checksum(c, a).collect()}
    first = of(cases, assets)
    assert set(first) == {"d", "e", "f"} and of(cases.orderBy(F.desc("case_id")).repartition(7), assets.orderBy(F.rand(1))) == first
    other = of(cases.withColumn("query", F.when(F.col("case_id") == "c7", "changed").otherwise(F.col("query"))), assets)
    assert other["d"] != first["d"] and other["e"] == first["e"]
    assert of(cases, assets.withColumn("checksum", F.lit("0b")))["d"] != first["d"]


def test_operations_as_rows_are_judged_as_one_by_one(spark):
    rng, data = random.Random(4), spark.createDataFrame([], "a int, b string, c double, d boolean, e date")
    schema = spark.createDataFrame([(f.name, analytics.kind(f)) for f in data.schema.fields], "name string, data_type string")
    names = ["a", "b", "c", "d", "e", "nope"]
    some = lambda most: [rng.choice(names[: rng.choice([5, 6])]) for _ in range(rng.randint(0, most))]
    ops = []
    for i in range(200):
        aggs = [(rng.choice(["sum", "count", "mean"]), rng.choice(["a", "c", "c", "b", None]), rng.choice(["total", "x_1", "1x", None])) for _ in range(rng.choice([0, 1, 1, 2, 11]))]
        ops.append((str(i), rng.random() < 0.3, some(4), aggs, rng.choice([None, some(1)]), some(1), rng.choice([None, 0, 1, 1000, 1001])))
    got = {r.op_id: r for r in analytics.check_operations(spark.createDataFrame(ops, analytics.OPERATION), schema).collect()}
    for op_id, grouped, keys, aggs, sort, columns, limit in ops:
        op = {"grouped": grouped, "keys": keys, "aggs": [{"fn": f} | ({"field": c} if c else {}) | ({"alias": x} if x else {}) for f, c, x in aggs], "sort": [(c, 1) for c in sort or []], "columns": columns} | ({} if limit is None else {"limit": limit})
        try:
            analytics.validate_op(data.schema, op)
            assert got[op_id].reason is None and got[op_id].detail == ""
        except analytics.InvalidOperation as e:
            assert got[op_id].reason is not None
            if "unknown" in str(e):
                assert got[op_id].reason == "UNKNOWN_COLUMN" and set(got[op_id].detail.split(",")) == {c for c in [*keys, *[c for _, c, _ in aggs if c], *(sort or []), *columns] if c not in data.columns}


def test_upload_intents(spark):
    rows = [("a", "document", "p1", 5, 10, None), ("b", "video", "p1", 5, 10, None), ("c", "document", "p1", 5, 10, 1), ("d", "document", "p1", 5, 1, None), ("e", "document", "p9", 5, 10, None), ("f", "document", "p1", 6, 10, None)]
    intents = spark.createDataFrame(rows, "upload_id string, asset_type string, object_path string, size_bytes int, e int, c int").withColumn("expires_at", F.timestamp_seconds("e")).withColumn("consumed_at", F.timestamp_seconds("c"))
    got = store.valid_intents(intents, spark.createDataFrame([("p1", 5)], "object_path string, stored_bytes int"), "1970-01-01 00:00:05", "document")
    assert [r.reason for r in got.orderBy("upload_id").collect()] == [None, "WRONG_ASSET_TYPE", "ALREADY_CONSUMED", "EXPIRED", "OBJECT_MISSING", "SIZE_MISMATCH"]


class Counted:
    """A map state in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def iterator(self):
        return iter(self.held.items())


def test_events_beside_the_head_call_no_state(monkeypatch):
    monkeypatch.setattr(st, "RECENT", 20)
    state, want = Counted(), st.Fold(None, st.Held())
    own = st.Fold(None, st.KeptEvents(state, [], False))
    order = [i ^ 3 for i in range(40, 100)] + list(range(1, 40)) + [50, 5]
    for n, at in enumerate(order, 1):
        event = {"sequence": at, "type": "generation.token" if at % 3 else "route.selected", "token": f"t{at} ", "route": str(at)}
        own.take(event)
        want.take(event)
        if n == 20:
            assert state.calls == 0
        kept = json.loads(json.dumps([own.head, list(own.events.recent.items()), own.events.moved]))  # as between batches
        own = st.Fold(kept[0], st.KeptEvents(state, *kept[1:]))
        assert own.row() == want.row()
    assert len(state.held) + len(own.events.recent) == 99 and len(own.events.recent) <= 20
