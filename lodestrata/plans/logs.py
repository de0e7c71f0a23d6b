"""Queries of event logs: a user's events as one request, in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.plans.common import query, table
from lodestrata.sources.staging import new_path
from lodestrata.streaming import events as ev
from lodestrata.streaming import state

KINDS = {"signup": "request.started", "view": "route.selected", "click": "retrieval.completed", "purchase": "response.completed", "error": "error"}
SEQ = """s AS (SELECT *, CAST(user_id AS VARCHAR) AS request_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence, CASE event_type WHEN 'signup' THEN 'request.started' WHEN 'view' THEN 'route.selected' WHEN 'click' THEN 'retrieval.completed' WHEN 'purchase' THEN 'response.completed' ELSE 'error' END AS type,
  CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'document_search' WHEN 1 THEN 'video_search' WHEN 2 THEN 'data_analytics' ELSE 'direct_answer' END AS route, CAST(floor(value) AS INTEGER) AS v FROM events)"""


def requests(spark, d):
    e = table(spark, d, "events").withColumn("request_id", F.col("user_id").cast("string"))
    e = e.withColumn("sequence", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    kind = F.create_map(*[F.lit(x) for k in KINDS.items() for x in k])
    v = F.floor("value").cast("int")
    routes = F.array(*map(F.lit, ev.ROUTES))
    route = F.get(routes, v % 4)
    e = e.withColumn("type", F.element_at(kind, F.col("event_type"))).withColumn("route", route).withColumn("tool", F.when(v % 2 == 0, "document_search").otherwise("video_search"))
    return e.select("request_id", "sequence", "type", "ts", "route", "tool", v.alias("candidate_count"), v.alias("latency_ms"), F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("final_response"), F.lit(0).alias("citation_count"), F.lit(0).alias("rewrite_count"), F.lit("STREAM_FAILED").alias("code"), F.concat(F.lit("failed "), F.col("event_id").cast("string")).alias("message"))


@query(f"""WITH {SEQ} SELECT request_id, count(*) AS n_events, min(sequence) = 1 AS starts_at_one, max(sequence) - min(sequence) + 1 = count(*) AS contiguous,
  count(*) FILTER (type IN ('response.completed', 'error')) = 1 AND coalesce(max(sequence) FILTER (type IN ('response.completed', 'error')) = max(sequence), false) AS one_terminal_last, starts_at_one AND contiguous AND one_terminal_last AS valid FROM s GROUP BY 1""")
def check_sequences(spark, d):
    return ev.check_sequences(requests(spark, d))


FOLD = f"""WITH {SEQ} SELECT request_id, CASE arg_max(type, sequence) WHEN 'request.started' THEN 'Thinking' WHEN 'route.selected' THEN CASE WHEN arg_max(route, sequence) = 'data_analytics' THEN 'Analyzing Data' ELSE 'Routing' END
  WHEN 'retrieval.completed' THEN CASE WHEN arg_max(v, sequence) % 2 = 0 THEN 'Searching Documents' ELSE 'Searching Video' END WHEN 'response.completed' THEN 'Complete' ELSE 'Error' END AS phase,
  arg_max(route, sequence) FILTER (type = 'route.selected') AS route, coalesce(arg_max('answer ' || event_id, sequence) FILTER (type = 'response.completed'), '') AS answer, arg_max('failed ' || event_id, sequence) FILTER (type = 'error') AS error, CAST(count(*) AS INTEGER) AS n_activity FROM s GROUP BY 1"""


@query(FOLD)
def fold_requests(spark, d):
    return ev.fold_requests(ev.distinct_events(requests(spark, d))).select("request_id", "phase", "route", "answer", "error", F.size("activity").alias("n_activity"))


METRICS = f"""WITH {SEQ}, p AS (SELECT request_id, max(route) FILTER (type = 'route.selected') AS route, sum(v) FILTER (type = 'retrieval.completed') AS r, max(v) FILTER (type = 'response.completed') AS t, max(0) FILTER (type = 'response.completed') AS c, count(*) FILTER (type = 'error') AS e FROM s GROUP BY 1)
SELECT route, count(*) AS requests, coalesce(sum(r), 0)::BIGINT AS candidates, coalesce(sum(r), 0)::BIGINT AS retrieval_ms, coalesce(sum(t), 0)::BIGINT AS total_ms, coalesce(sum(c), 0)::BIGINT AS citations, 0::BIGINT AS rewrites, sum(e)::BIGINT AS errors FROM p GROUP BY 1"""


def in_arrival(spark, d, files: int = 6) -> DataFrame:
    """The requests' events as a stream of files, in an order other than that of time."""
    path = new_path(spark, "arrivals")
    requests(spark, d).repartition(files, F.xxhash64("request_id", "sequence")).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)


def run_stream(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives until its input ends, with the micro-batch in which it came."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "stream")

    def keep(df: DataFrame, batch: int) -> None:  # a batch that is run again replaces what it left
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True)
    writer.option("checkpointLocation", new_path(spark, "progress")).start().awaitTermination()
    return spark.read.schema(f"{ddl(stream)}, batch int").parquet(path)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


@query(FOLD)
def fold_requests_stream(spark, d):
    """The last state that the stream gives of each request."""
    state.use_rocksdb(spark)
    out = run_stream(state.fold_requests_stream(in_arrival(spark, d), None), "update")
    newest = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("batch")))
    last = out.withColumn("n", newest).where("n = 1")
    return last.select("request_id", "phase", "route", "answer", "error", F.size("activity").alias("n_activity"))


@query(METRICS)
def request_metrics_stream(spark, d):
    state.use_rocksdb(spark)
    return state.route_totals(run_stream(state.request_metrics_stream(in_arrival(spark, d), None), "append"))


@query(METRICS)
def request_metrics(spark, d):
    return ev.request_metrics(requests(spark, d))


@query("SELECT 'STREAM_FAILED' AS code, count(*) AS errors FROM events WHERE event_type = 'error'")
def error_counts(spark, d):
    return ev.error_counts(requests(spark, d))


@query(f"""WITH {SEQ}, o AS (SELECT * FROM s WHERE type NOT IN ('response.completed', 'error')), m AS (SELECT max(ts) AS now FROM events)
SELECT request_id, CAST(max(sequence) + 1 AS INTEGER) AS sequence, 'error' AS type, 'STREAM_TIMEOUT' AS code FROM o, m GROUP BY request_id, now HAVING date_diff('second', date_trunc('second', max(ts)), date_trunc('second', now)) > 86400""")
def close_stale(spark, d):
    """Requests taken without their ends, against the time of the newest event and a timeout of a day."""
    e = requests(spark, d)
    now = e.agg(F.max("ts").alias("now")).head()[0]
    return ev.close_stale_requests(e.where(~F.col("type").isin(ev.TERMINAL)), F.lit(now), 86_400).drop("ts")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, ms + 86400000 AS reset_ms, 1::BIGINT AS used FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN w.reset_ms <= e.ms THEN e.ms + 86400000 ELSE w.reset_ms END, CASE WHEN w.reset_ms <= e.ms THEN 1 ELSE w.used + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, used <= 3 AS allowed, greatest(0, 3 - used)::BIGINT AS remaining, reset_ms FROM w""")
def rate_limit_users(spark, d):
    found = ev.rate_limit(table(spark, d, "events"), "user_id", 3, 86_400_000)
    return found.select("user_id", "event_id", "allowed", "remaining", F.unix_millis("reset_at").alias("reset_ms"))


@query("""WITH a AS (SELECT event_id, user_id || event_type AS object_path, ts, min(ts) OVER (PARTITION BY user_id, event_type) + to_seconds(floor(value)::BIGINT * 86400) AS expires_at FROM events),
n AS (SELECT *, sum(CASE WHEN ts < expires_at THEN 1 ELSE 0 END) OVER (PARTITION BY object_path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT event_id, object_path, CASE WHEN NOT ts < expires_at THEN 'EXPIRED' WHEN k = 1 THEN 'CONSUMED' ELSE 'REPLAYED' END AS outcome FROM n""")
def consume_once(spark, d):
    e = table(spark, d, "events")
    path = F.concat(F.col("user_id").cast("string"), "event_type")
    first = F.min("ts").over(W.partitionBy("user_id", "event_type"))
    until = F.timestamp_micros(F.unix_micros(first.cast("timestamp")) + F.floor("value").cast("long") * 86_400_000_000)
    return ev.consume_once(e.select("event_id", path.alias("object_path"), F.col("ts").cast("timestamp").alias("ts"), until.alias("expires_at"))).select("event_id", "object_path", "outcome")


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND floor(value)::BIGINT % 3 = 0 THEN 'UNKNOWN_TYPE' WHEN event_type = 'click' AND floor(value)::BIGINT > 100 THEN 'BAD_FIELDS' WHEN event_type = 'purchase' AND floor(value)::BIGINT % 2 = 1 THEN 'CITATION_COUNT_MISMATCH'
  WHEN event_type = 'error' AND floor(value)::BIGINT % 5 = 0 THEN 'FRAME_MISMATCH' WHEN event_type = 'signup' AND floor(value)::BIGINT % 7 = 0 THEN 'NOT_AN_EVENT' END AS reason FROM events""")
def validate_events(spark, d):
    """Events written as JSON with faults by rule, and read again."""
    e = table(spark, d, "events")
    v = F.floor("value").cast("int")
    of = lambda kind, column: F.when(F.col("event_type") == kind, column)
    kind = F.create_map(*[F.lit(x) for k in KINDS.items() for x in k])
    name = F.when((F.col("event_type") == "view") & (v % 3 == 0), "route.unknown").when((F.col("event_type") == "signup") & (v % 7 == 0), F.lit(None)).otherwise(F.element_at(kind, F.col("event_type")))
    body = F.struct(
        F.lit("1.0").alias("schema_version"), F.col("user_id").cast("string").alias("request_id"), F.lit("c").alias("correlation_id"), (F.col("event_id") + 1).alias("sequence"), name.alias("type"), F.lit("thread").alias("thread_id"), of("view", F.lit("direct_answer")).alias("route"),
        of("click", F.lit("document_search")).alias("tool"), of("click", v).alias("candidate_count"), F.lit(5).alias("latency_ms"), F.lit("done").alias("final_response"), F.array().cast("array<struct<citation_id: string>>").alias("citations"), (v % 2).alias("citation_count"), F.lit(0).alias("rewrite_count"),
        F.lit("STREAM_FAILED").alias("code"), F.lit("stopped").alias("message"), F.lit(True).alias("retryable"),
    )
    frame = F.when((F.col("event_type") == "error") & (v % 5 == 0), "response.completed").otherwise(name)
    rows = e.select("event_id", F.to_json(body).alias("value"), (F.col("event_id") + 1).cast("string").alias("frame_id"), frame.alias("frame_type")).withColumn("event", F.from_json("value", ev.EVENT))
    return ev.validate_events(rows).select("event_id", "reason")
