"""Topics, streams and run-log questions, with the events table as messages and as a run log."""

from pyspark.sql import functions as F

from steplake.conformance.registry import query, table
from steplake.operators import quality_state
from steplake.operators.nested import infer_value_schema
from steplake.operators.quality import Rule
from steplake.plans import runlog
from steplake.plans.step_list import Step
from steplake.session import scratch_path
from steplake.sources import storage
from steplake.streaming import streams, topic_files, topics

# ---- the events table as a topic with three partitions; offsets have gaps, as in a compacted topic

def _messages(df):
    return df.select(
        F.col("event_id").alias("offset"), (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("key"),
        # every 50th message is broken
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), F.col("event_id")))
        .otherwise(F.to_json(F.struct("event_type", F.from_json("props", "k bigint")["k"].alias("k")))).alias("value"),
        F.create_map(F.lit("source"), F.lit("events")).alias("headers"))


def _event_stream(spark, sf):
    """The events table as a stream, whether it is one file or a folder of files."""
    schema = table(spark, sf, "events").schema
    path = f"{sf}/events.parquet"
    reader = spark.readStream.schema(schema)
    if storage.children(spark, path)[0][0] == "events.parquet":
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    return reader.parquet(path)


_PARSED = """SELECT event_id AS "offset", CAST(user_id % 3 AS INTEGER) AS "partition",
  CASE WHEN event_id % 50 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 50 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 50 = 0 THEN concat('{broken ', event_id) END AS _corrupt FROM events"""


@query("peek_partition", """
SELECT event_id AS "offset", CAST(user_id AS VARCHAR) AS key FROM events WHERE user_id % 3 = 1 ORDER BY event_id LIMIT 20""")
def peek_partition(spark, sf):
    return topics.peek(_messages(table(spark, sf, "events")), 1, 20).select("offset", "key")


@query("parse_values", _PARSED)
def parse_values(spark, sf):
    return topics.parse_values(_messages(table(spark, sf, "events")), "event_type string, k bigint",
                               ["offset", "partition"])


@query("infer_topic_schema", _PARSED)
def infer_topic_schema(spark, sf):
    """The value schema comes from the messages themselves."""
    messages = _messages(table(spark, sf, "events"))
    return topics.parse_values(messages, infer_value_schema(messages), ["offset", "partition"])


_LAG = """SELECT CAST(user_id % 3 AS INTEGER) AS "partition",
  coalesce(max(event_id) FILTER (WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 3 > 0) + 1, 0) AS current_offset,
  max(event_id) + 1 AS high_watermark FROM events GROUP BY 1"""


def _lag(spark, sf):
    messages = _messages(table(spark, sf, "events"))
    committed = (topics.high_watermarks(messages.filter("timestamp < TIMESTAMP '2024-01-20' AND partition > 0"))
                 .withColumnRenamed("high_watermark", "current_offset"))
    return topics.consumer_lag(committed, topics.high_watermarks(messages))


@query("consumer_lag", f"SELECT *, high_watermark - current_offset AS lag FROM ({_LAG})")
def consumer_lag(spark, sf):
    return _lag(spark, sf)


@query("total_lag", f"SELECT CAST(sum(high_watermark - current_offset) AS BIGINT) AS total_lag FROM ({_LAG})")
def total_lag(spark, sf):
    return topics.total_lag(_lag(spark, sf))


@query("produce", """
SELECT CAST(user_id AS VARCHAR) AS key, CAST(user_id % 3 AS INTEGER) AS "partition",
  concat('{"event_id":', event_id, ',"user_id":', user_id, ',"event_type":"', event_type, '"}') AS value FROM events""")
def produce(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.col("user_id") % 3).alias("p"))
    return topics.to_messages(rows, "user_id", "p")


@query("topic_round_trip", """
SELECT event_id AS "offset", CAST(user_id % 3 AS INTEGER) AS "partition", event_type, CAST(user_id AS VARCHAR) AS key, value FROM events""")
def topic_round_trip(spark, sf):
    """Rows land as messages and come back as typed rows."""
    path = scratch_path(spark, "messages")
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", (F.col("user_id") % 3).alias("p"))
    topics.write_message_files(rows, path, "user_id", "p", "event_id")
    messages = topics.read_message_files(spark, path)
    return topics.parse_values(messages, "event_type string, value double", ["offset", "partition", "key"]).drop("_corrupt")


# ---- the events as a topic kept in files

_NUMBERED_SQL = """SELECT CAST(user_id % 3 AS INTEGER) AS "partition", row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS "offset",
  CAST(user_id AS VARCHAR) AS key, event_type, value FROM events"""


def _landed_topic(spark, sf):
    """Tasks write in the order of event_id, and offsets follow it."""
    path = scratch_path(spark, "topic")
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", (F.col("user_id") % 3).alias("p"), "ts").orderBy("event_id")
    topic_files.append_topic_files(topic_files.as_messages(rows, "user_id", "p", "ts"), path)
    return path


@query("topic_files_round_trip", _NUMBERED_SQL)
def topic_files_round_trip(spark, sf):
    messages = topic_files.read_topic_files(spark, _landed_topic(spark, sf))
    return topics.parse_values(messages, "event_type string, value double", ["partition", "offset", "key"]).drop("_corrupt")


@query("peek_from_offset", f"""SELECT "offset", key FROM ({_NUMBERED_SQL}) WHERE "partition" = 1 AND "offset" >= 30 AND "offset" < 50""")
def peek_from_offset(spark, sf):
    """Twenty messages from an offset on; the source opens only what holds them."""
    return topic_files.peek_files(spark, _landed_topic(spark, sf), 1, 30).select("offset", "key")


@query("topic_files_lag", """
SELECT CAST(user_id % 3 AS INTEGER) AS "partition", count(*) AS current_offset, 2 * count(*) AS high_watermark, count(*) AS lag FROM events GROUP BY 1""")
def topic_files_lag(spark, sf):
    """A stream has copied all messages when as many again are landed: its lag comes from its checkpoint and the files' names."""
    path, copy, checkpoint = _landed_topic(spark, sf), scratch_path(spark, "copy"), scratch_path(spark, "offsets")
    stream = topic_files.read_topic_files(spark, path, streaming=True).select("partition", "key", "value")
    topic_files.stream_to_topic_files(stream, copy, checkpoint, "lag")
    topic_files.append_topic_files(topic_files.read_topic_files(spark, copy).select("partition", "key", "value"), path)
    return topics.consumer_lag(topic_files.committed_offsets(spark, checkpoint), topic_files.end_offsets(spark, path))


@query("throughput_minute", """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS messages
FROM events GROUP BY 1, 2""")
def throughput_minute(spark, sf):
    path = scratch_path(spark, "throughput")
    # a table is read in whatever order its files come, so nothing counts as late
    counted = streams.throughput(_event_stream(spark, sf), "ts", "1 minute", ["event_type"], lateness="3650 days")
    streams.changed_totals(counted, path, scratch_path(spark, "offsets"))
    return streams.newest_totals(spark.read.parquet(path), ["window_start", "event_type"]).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "messages")


@query("throughput_expiring", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS messages FROM events GROUP BY 1""")
def throughput_expiring(spark, sf):
    """Loads come in the order of time, so hours leave the state soon after they end; what was written of them stays."""
    landed, path, checkpoint = (scratch_path(spark, name) for name in ("loads", "hours", "offsets"))
    events = table(spark, sf, "events").select("ts")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.floor(4 * (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")))
                           / F.greatest(F.unix_micros(F.lit(last).cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")), F.lit(1))), F.lit(3))
    for load in range(4):
        events.filter(part == load).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(events.schema).parquet(landed)
        running = streams.changed_totals(streams.throughput(stream, "ts", "1 hour", lateness="2 hours"), path, checkpoint)
    kept = running.lastProgress["stateOperators"][0]
    newest = streams.newest_totals(spark.read.parquet(path), ["window_start", "window_end"])
    if kept["numRowsTotal"] * 2 > newest.count() + 10 or kept["numRowsDroppedByWatermark"]:
        raise RuntimeError(f"hours that have ended stay in the state, or rows were late: {kept}")
    return newest.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "messages")


@query("throughput_batch", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS messages FROM events GROUP BY 1""")
def throughput_batch(spark, sf):
    return streams.throughput(table(spark, sf, "events"), "ts", "1 hour").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "messages")


@query("stream_filter_append", "SELECT event_id, user_id, event_type, value FROM events WHERE value > 10")
def stream_filter_append(spark, sf):
    path = scratch_path(spark, "outliers")
    streams.filter_append(_event_stream(spark, sf).drop("ts", "props"), "value > 10", path,
                          scratch_path(spark, "offsets"), ["event_type"])
    return spark.read.parquet(path)


@query("stream_steps", """
SELECT event_id AS id, event_type, CAST(round_even(value, 0) AS INTEGER) AS value, user_id % 2 AS side FROM events
WHERE event_type <> 'view'""")
def stream_steps(spark, sf):
    path = scratch_path(spark, "steps")
    cleaned = streams.stream_steps(_event_stream(spark, sf).drop("ts", "props"), [
        Step("filter", {"column": "event_type", "operator": "!=", "value": "view"}),
        Step("drop_null", {"columns": ["value"]}), Step("derive", {"column_name": "side", "expression": "user_id % 2"}),
        Step("cast", {"casts": {"value": "int"}}), Step("rename", {"mapping": {"event_id": "id"}})])
    streams.append_stream(cleaned.drop("user_id"), path, scratch_path(spark, "offsets"))
    return spark.read.parquet(path)


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf):
    """Every event arrives twice, in files without any order that are read one at a time, and is kept once."""
    events = table(spark, sf, "events").select("event_id", "user_id")
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "dedup")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    twice.repartitionById(5, F.pmod(F.xxhash64("event_id", "copy"), F.lit(5)).cast("int")).write.parquet(landed)
    stream = spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    streams.drop_repeats(stream, ["event_id"], path, scratch_path(spark, "offsets"))
    return spark.read.parquet(path).select("event_id", "user_id")


@query("stream_first_rows", "SELECT event_id, user_id, 10 * (event_id % 4) + 1 AS version FROM events")
def stream_first_rows(spark, sf):
    """Every event comes in up to four loads, three versions in each, in any order. The stream is started anew from its
    checkpoint for each load and keeps the lowest version of an event's first load."""
    events = table(spark, sf, "events").select("event_id", "user_id")
    landed, path, checkpoint = (scratch_path(spark, name) for name in ("loads", "first", "offsets"))
    for load in range(4):
        versions = F.explode(F.array(*[F.lit(10 * load + v) for v in (3, 1, 2)]))
        (events.filter(F.col("event_id") % 4 <= load).withColumn("version", versions)
         .withColumn("version", F.col("version").cast("bigint")).write.mode("append").parquet(landed))
        stream = spark.readStream.schema("event_id bigint, user_id bigint, version bigint").parquet(landed)
        streams.drop_repeats(stream, ["event_id"], path, checkpoint, order_by=["version"])
    return spark.read.parquet(path).select("event_id", "user_id", "version")


@query("stream_parse", _PARSED)
def stream_parse(spark, sf):
    path = scratch_path(spark, "parsed")
    parsed = topics.parse_values(_messages(_event_stream(spark, sf)), "event_type string, k bigint", ["offset", "partition"])
    streams.append_stream(parsed, path, scratch_path(spark, "offsets"))
    return spark.read.parquet(path)


@query("stream_quality", """
SELECT 's1' AS rule_id, count(*) AS total_rows, count(*) FILTER (WHERE value > 20) AS failed_rows FROM events
UNION ALL SELECT 's2', count(*), count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) FROM events""")
def stream_quality(spark, sf):
    path = scratch_path(spark, "quality")
    rules = [Rule("s1", "range", "value", {"max": 20}), Rule("s2", "allowed_values", "event_type", {"values": ["view", "click"]})]
    streams.stream_quality(_event_stream(spark, sf), rules, path, scratch_path(spark, "offsets"), "events")
    return spark.read.parquet(path).groupBy("rule_id").agg(F.sum("total_rows").alias("total_rows"),
                                                           F.sum("failed_rows").alias("failed_rows"))


@query("stream_whole_quality", """
SELECT 's1' AS rule_id, count(*) AS total_rows, count(*) FILTER (WHERE value > 20) AS failed_rows FROM events
UNION ALL SELECT 's2', count(*), count(user_id) - count(DISTINCT user_id) FROM events""")
def stream_whole_quality(spark, sf):
    """Each micro-batch is judged once; the whole table's results, repeats across batches included, come from what they left."""
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "judged")
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    events.repartitionById(4, F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int")).write.parquet(landed)
    rules = [Rule("s1", "range", "value", {"max": 20}), Rule("s2", "unique", "user_id")]
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    quality_state.stream_whole_quality(stream, rules, path, scratch_path(spark, "offsets"))
    return quality_state.whole_results(spark, rules, path).select("rule_id", "total_rows", "failed_rows")


# ---- the events table as a run log

_RUNS = """SELECT CAST(event_id AS {text}) AS id, user_id AS target_id, concat('Target-', user_id) AS target_name,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS status, ts AS started_at,
  value AS duration_sec, event_id % 1009 AS rows_processed, event_id % 3 + 1 AS attempt FROM {events}"""
_RUN_SQL = _RUNS.format(text="VARCHAR", events="events")


def _runs(spark, sf):
    return spark.sql(_RUNS.format(text="string", events="{events}"), events=table(spark, sf, "events"))


def _now(spark, sf):
    """The newest event stands for the present."""
    return table(spark, sf, "events").agg(F.max("ts")).scalar()


@query("run_list", f"""
SELECT id, target_name, status FROM ({_RUN_SQL}) WHERE status = 'failed' AND lower(target_name) LIKE '%get-1%'
ORDER BY started_at DESC, id LIMIT 50""")
def run_list(spark, sf):
    return runlog.list_runs(_runs(spark, sf), "failed", "GET-1").select("id", "target_name", "status")


@query("run_status_summary", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'cancelled') AS cancelled
FROM ({_RUN_SQL}) WHERE CAST(started_at AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events)""")
def run_status_summary(spark, sf):
    return runlog.status_summary(_runs(spark, sf), _now(spark, sf))


@query("run_timeline", f"""
SELECT target_name, id, CAST(epoch_us(started_at) - epoch_us(since) AS BIGINT) AS offset_micros, duration_sec, status, rows_processed
FROM ({_RUN_SQL}), (SELECT max(ts) - INTERVAL 24 HOUR AS since FROM events) WHERE started_at > since""")
def run_timeline(spark, sf):
    return runlog.run_timeline(_runs(spark, sf), _now(spark, sf)).drop("started_at")


_FRESH_SQL = """SELECT table_name, max_age_seconds, age_seconds, CASE WHEN age_seconds > 2 * max_age_seconds THEN 'critical'
  WHEN age_seconds > max_age_seconds THEN 'stale' ELSE 'fresh' END AS level, last_updated FROM
 (SELECT concat('user-', user_id) AS table_name, CASE WHEN user_id % 4 = 0 THEN 14400 ELSE 1800 * (user_id % 4) END AS max_age_seconds,
   CAST(floor(epoch_us((SELECT max(ts) FROM events)) / 1000000) - floor(epoch_us(max(ts)) / 1000000) AS BIGINT) AS age_seconds,
   max(ts) AS last_updated FROM events GROUP BY user_id)"""


def _fresh(spark, sf):
    events = table(spark, sf, "events")
    updates = events.select(F.concat(F.lit("user-"), "user_id").alias("table_name"), F.col("ts").alias("updated_at"))
    limits = events.filter("user_id % 4 <> 0").select("user_id").distinct().select(
        F.concat(F.lit("user-"), "user_id").alias("table_name"), (F.col("user_id") % 4 * 1800).alias("max_age_seconds"))
    return runlog.freshness(updates, limits, _now(spark, sf), 14400)


@query("freshness", f"SELECT * EXCLUDE (last_updated) FROM ({_FRESH_SQL})")
def freshness(spark, sf):
    return _fresh(spark, sf).drop("last_updated")


@query("slowest_runs", f"SELECT id, duration_sec FROM ({_RUN_SQL}) ORDER BY duration_sec DESC, id LIMIT 10")
def slowest_runs(spark, sf):
    return runlog.slowest_runs(_runs(spark, sf), 10).select("id", "duration_sec")


@query("heaviest_runs", f"SELECT id, rows_processed FROM ({_RUN_SQL}) ORDER BY rows_processed DESC, id LIMIT 10")
def heaviest_runs(spark, sf):
    return runlog.slowest_runs(_runs(spark, sf), 10, "rows_processed").select("id", "rows_processed")


def _late(spark, sf):
    schedules = table(spark, sf, "events").select(F.col("user_id").alias("target_id")).distinct().selectExpr(
        "target_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS first_slot", "21600 AS every_seconds")
    return runlog.late_runs(schedules, _runs(spark, sf), "2024-01-05 00:00:00", "2024-01-10 00:00:00")


_LATE_SQL = """SELECT target_id, slot FROM (SELECT target_id, slot FROM (SELECT DISTINCT user_id AS target_id FROM events)
  CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-10', INTERVAL 6 HOUR)) AS slot))
EXCEPT SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') FROM events"""


@query("late_runs", f"SELECT target_id, strftime(slot, '%Y-%m-%d %H:%M') AS slot FROM ({_LATE_SQL})")
def late_runs(spark, sf):
    return _late(spark, sf).select("target_id", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"))


@query("attention_list", f"""
SELECT severity, status, name, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS "at" FROM (
SELECT 1 AS severity, 'failed' AS status, CAST(target_id AS VARCHAR) AS name, started_at AS moment FROM ({_RUN_SQL}) WHERE status = 'failed'
UNION ALL SELECT 2, 'late', CAST(target_id AS VARCHAR), slot FROM ({_LATE_SQL})
UNION ALL SELECT CASE level WHEN 'critical' THEN 1 ELSE 3 END, level, table_name, last_updated FROM ({_FRESH_SQL}) WHERE level <> 'fresh')""")
def attention_list(spark, sf):
    found = runlog.attention_list(_runs(spark, sf), _late(spark, sf), _fresh(spark, sf))
    return found.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _nested_runs(spark, sf):
    """Two or three steps and one log line per step, made from the run itself."""
    runs = _runs(spark, sf)
    part = lambda n, rows_in, rows_out: F.struct(
        F.lit(f"s{n}").alias("step_id"), F.lit(f"step {n}").alias("step_name"), F.col("status").alias("status"),
        (F.col("duration_sec") / 4).alias("duration_sec"), rows_in.alias("rows_in"), rows_out.alias("rows_out"))
    half = F.floor(F.col("rows_processed") / 2)
    steps = F.when(F.col("attempt") == 1, F.array(part(1, F.col("rows_processed"), half), part(2, half, half))).otherwise(
        F.array(part(1, F.col("rows_processed"), half), part(2, half, half), part(3, half, half)))
    logs = F.transform(steps, lambda s: F.struct(F.lit("10:00:00").alias("timestamp"),
                                                 F.when(s["status"] == "failed", "ERROR").otherwise("INFO").alias("level"),
                                                 F.concat(s["step_name"], F.lit(" done")).alias("message")))
    return runs.withColumns({"step_timelines": steps, "logs": logs})


_STEP_SQL = f"""FROM ({_RUN_SQL}), (VALUES (0), (1), (2)) v(n) WHERE n < CASE WHEN attempt = 1 THEN 2 ELSE 3 END"""


@query("step_rows", f"""
SELECT id AS run_id, n AS position, concat('s', n + 1) AS step_id, concat('step ', n + 1) AS step_name, status,
  duration_sec / 4 AS duration_sec, CASE n WHEN 0 THEN rows_processed ELSE rows_processed // 2 END AS rows_in,
  rows_processed // 2 AS rows_out {_STEP_SQL}""")
def step_rows(spark, sf):
    return runlog.step_rows(_nested_runs(spark, sf))


@query("log_rows", f"""
SELECT id AS run_id, n AS position, '10:00:00' AS "timestamp", 'ERROR' AS level, concat('step ', n + 1, ' done') AS message
{_STEP_SQL} AND status = 'failed'""")
def log_rows(spark, sf):
    return runlog.log_rows(_nested_runs(spark, sf), "ERROR")


@query("retry_last", f"""
SELECT target_id, strftime(day, '%Y-%m-%d') AS slot, attempts, id, status, attempt FROM
 (SELECT *, CAST(started_at AS DATE) AS day, count(*) OVER (PARTITION BY target_id, CAST(started_at AS DATE)) AS attempts,
   row_number() OVER (PARTITION BY target_id, CAST(started_at AS DATE) ORDER BY attempt DESC, started_at DESC, id DESC) AS rn
  FROM ({_RUN_SQL})) WHERE rn = 1""")
def retry_last(spark, sf):
    last = runlog.retry_last(_runs(spark, sf), F.to_date("started_at"))
    return last.select("target_id", F.date_format("slot", "yyyy-MM-dd").alias("slot"), "attempts", "id", "status", "attempt")
