"""Workflows, user code, run logs, streams, and the shape of physical plans."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import samples
from steplake.conformance.registry import table
from steplake.functions.sql import query_result, run_sql
from steplake.functions.user import Context, map_batches, map_groups, run_script
from steplake.operators.profile import profile
from steplake.operators.quality import Rule, evaluate
from steplake.operators.steps import deduplicate
from steplake.plans import runlog
from steplake.plans.step_list import Step, run_steps
from steplake.plans.workflow import Node, WorkflowError, plan_workflow, run_workflow, validate_workflow
from steplake.streaming import streams, topics

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- workflows

def test_order_and_cycle():
    nodes = [Node("A", "source"), Node("B", "filter"), Node("C", "destination")]
    edges = [("A", "B"), ("B", "C")]
    assert validate_workflow(nodes, edges) == ["A", "B", "C"]
    with pytest.raises(WorkflowError, match="cycle"):
        validate_workflow(nodes, edges + [("C", "A")])
    with pytest.raises(WorkflowError, match="unknown node"):
        validate_workflow(nodes, [("A", "X")])
    with pytest.raises(WorkflowError, match="unknown type"):
        validate_workflow([Node("A", "nope")], [])


def test_run_workflow(spark, folder):
    nodes = [
        Node("src", "source", {"table": "orders"}),
        Node("paid", "filter", {"condition": "state = 'back'"}),
        Node("tidy", "steps", {"steps": [Step("drop_null", {"column": "due"})]}),
        Node("ok", "quality_assert", {"rule": "regex", "column": "card", "params": {"pattern": "^C-.{1}"}}),
        Node("py", "python", {"function": lambda df, low: df.filter(F.col("loan") > low), "params": {"low": 1}}),
        Node("sql", "transform_sql", {"sql": "SELECT shelf, count(*) AS n FROM __input__ WHERE branch RLIKE '[a-z]{1}' GROUP BY 1"}),
        Node("one", "destination", {"path": f"{folder}/one.parquet"}),
        Node("two", "destination", {"path": f"{folder}/two.parquet"}),
    ]
    edges = [("src", "paid"), ("paid", "tidy"), ("tidy", "ok"), ("ok", "py"), ("py", "sql"), ("sql", "one"), ("py", "two")]
    result = run_workflow(spark, nodes, edges, {"orders": samples.loans(spark)})
    assert result.success, result.error
    rows = {k: v.get("rows") for k, v in result.node_results.items()}
    assert (rows["paid"], rows["tidy"], rows["py"]) == (10, 8, 7)
    assert result.node_results["two"]["message"] == "7 rows stored"
    assert spark.read.parquet(f"{folder}/one.parquet").agg(F.sum("n")).first()[0] == 7
    assert not spark.catalog.listTables() or all(not t.name.startswith("steplake_") for t in spark.catalog.listTables())


def test_workflow_failures(spark, folder):
    tables = {"orders": samples.loans(spark)}
    nodes = [Node("src", "source", {"table": "orders"}), Node("q", "quality_assert", {"column": "due"}, "dates"),
             Node("out", "destination", {"path": f"{folder}/x.parquet"})]
    edges = [("src", "q"), ("q", "out")]
    result = run_workflow(spark, nodes, edges, tables)
    assert not result.success and "dates" in result.error and "out" not in result.node_results
    warn = [nodes[0], Node("q", "quality_assert", {"column": "due", "severity": "warn"}), nodes[2]]
    assert run_workflow(spark, warn, edges, tables).success
    wrong = [nodes[0], Node("f", "filter", {"condition": "nope > 1"})]
    with pytest.raises(WorkflowError, match="nope"):
        plan_workflow(spark, wrong, [("src", "f")], tables)
    with pytest.raises(WorkflowError, match="brnch"):
        plan_workflow(spark, [nodes[0], Node("f", "filter", {"requires": ["brnch"]})], [("src", "f")], tables)


# ---- SQL and user code

def test_run_sql(spark):
    orders = samples.loans(spark)
    assert query_result(spark, "SELECT count(*) AS n FROM {o}", o=orders)["rows"] == [[15]]
    assert run_sql(spark, "SELECT * FROM {o}", 5, o=orders).count() == 5
    with pytest.raises(ValueError, match="empty"):
        run_sql(spark, "  ")


def test_script(spark, folder):
    context = Context(spark, {"orders": samples.loans(spark)}, {"branch": "Mill"}, folder)

    def script(ctx):
        df = ctx.sql("SELECT state, count(*) AS n FROM {orders} GROUP BY 1")
        ctx.log("rows", 4)
        ctx.write_table("per_status", df)
        return ctx.read_table("per_status")
    out = run_script(context, script)
    assert out["tables_written"] == ["per_status"] and out["log"] == ["rows 4"]
    assert out["preview"]["columns"] == ["state", "n"] and len(out["preview"]["rows"]) == 3
    context.write_table("per_status", context.read_table("per_status").limit(0), "append")
    assert context.read_table("per_status").count() == 3
    spark.sql("DROP TABLE per_status")


def test_batches_and_groups(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    doubled = map_batches(df, lambda b: b.assign(id=b["id"] * 2), "id bigint, g bigint")
    assert doubled.agg(F.sum("id")).first()[0] == 999 * 1000

    def size(key, batches):
        yield pd.DataFrame({"g": [key[0]], "n": [sum(len(b) for b in batches)]})
    assert sorted(tuple(r) for r in map_groups(df, ["g"], size, "g bigint, n bigint").collect()) == [(0, 334), (1, 333), (2, 333)]


# ---- run logs

def test_run_log(spark):
    def run(i, name, status, started, seconds, attempt=1, steps=()):
        return (i, None, "pipeline", name, name, "schedule", status, "append", started, None, seconds, 10 * seconds, None,
                [(f"s{k}", f"Step {k}", s, 1.0, 5, 4, None) for k, s in enumerate(steps)],
                [("02:00:00", "INFO", "start"), ("02:00:01", "ERROR", "stop")][: 2 if status == "failed" else 1], {"a": "b"}, 1, attempt)
    raw = [run("r1", "loans_daily", "failed", "2026-03-06 02:00:00", 12, 1, ("ok", "error")),
           run("r2", "loans_daily", "success", "2026-03-06 02:10:00", 20, 2, ("ok", "ok", "ok")),
           run("r3", "sync_meters", "running", "2026-03-06 03:00:00", 45, 1, ("running",)),
           run("r4", "sync_meters", "success", "2026-03-04 03:00:00", 18)]
    text = spark.createDataFrame(raw, runlog.RUN.replace("timestamp_ntz", "string"))
    runs = text.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "finished_at")})
    assert runs.schema == spark.createDataFrame([], runlog.RUN).schema
    now = "2026-03-06 09:00:00"
    assert [r.id for r in runlog.list_runs(runs, "all", "LOANS").collect()] == ["r2", "r1"]
    assert [r.id for r in runlog.list_runs(runs, limit=1).collect()] == ["r3"]
    assert runlog.status_summary(runs, now).first().asDict() == {"total": 3, "success": 1, "failed": 1, "running": 1, "cancelled": 0}
    bars = {r.id: r.offset_micros for r in runlog.run_timeline(runs, now).collect()}
    assert bars == {"r1": 17 * 3600 * 10**6, "r2": (17 * 3600 + 600) * 10**6, "r3": 18 * 3600 * 10**6}
    assert [r.id for r in runlog.slowest_runs(runs, 2).collect()] == ["r3", "r2"]
    assert runlog.step_rows(runs).count() == 6 and runlog.log_rows(runs, "ERROR").count() == 1
    last = runlog.retry_last(runs, F.to_date("started_at")).filter("target_id = 'loans_daily'").first()
    assert (last.id, last.attempts) == ("r2", 2)
    schedules = spark.createDataFrame([("loans_daily", "2026-03-01 02:00:00", 86400), ("sync_meters", "2026-03-05 03:00:00", 86400)],
                                      "target_id string, first_slot string, every_seconds int"
                                      ).withColumn("first_slot", F.col("first_slot").cast("timestamp_ntz"))
    late = runlog.late_runs(schedules, runs, "2026-03-05 00:00:00", now)
    assert {(r.target_id, str(r.slot)) for r in late.collect()} == {
        ("loans_daily", "2026-03-05 02:00:00"), ("sync_meters", "2026-03-05 03:00:00")}
    strict = runlog.late_runs(schedules, runs.filter("id <> 'r1'"), "2026-03-06 00:00:00", now, tolerance_seconds=300)
    assert {r.target_id for r in strict.collect()} == {"loans_daily"}
    updates = spark.createDataFrame([("a", "2026-03-06 08:00:00"), ("b", "2026-03-05 00:00:00"), ("c", "2026-03-01 00:00:00")],
                                    "table_name string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    fresh = runlog.freshness(updates, None, now)
    assert {r.table_name: r.level for r in fresh.collect()} == {"a": "fresh", "b": "stale", "c": "critical"}
    listed = runlog.attention_list(runs, late, fresh).collect()
    assert [r.severity for r in listed] == sorted(r.severity for r in listed) and len(listed) == 5
    assert listed[-1].name == "b"


# ---- topics and streams

MESSAGES = "\n".join([
    '{"offset": 2, "partition": 0, "timestamp": "2026-03-06T10:00:30Z", "key": "k", "value": "{\\"meter\\": \\"d1\\", \\"flow\\": 101.5}", "headers": {"a": "b"}}',
    '{"offset": 1, "partition": 0, "timestamp": "2026-03-06T10:00:00Z", "key": "k", "value": "{\\"meter\\": \\"d1\\", \\"flow\\": 20.5}"}',
    '{"offset": 7, "partition": 1, "timestamp": "2026-03-06T10:01:00Z", "key": "k", "value": "not json"}'])


def test_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.json").write_text(MESSAGES)
    batch = topics.read_message_files(spark, str(tmp_path / "in"))
    assert batch.schema == topics.ENVELOPE
    assert [r.offset for r in topics.peek(batch, 0).collect()] == [1, 2]
    schema = "meter string, flow double"
    rows = {r.offset: r for r in topics.parse_values(batch, schema).collect()}
    assert rows[2].flow == 101.5 and rows[7]._corrupt == "not json" and rows[1]._corrupt is None
    stream = topics.read_message_files(spark, str(tmp_path / "in"), streaming=True)
    with pytest.raises(ValueError, match="bounded"):
        topics.peek(stream)
    hot = topics.parse_values(stream, schema)
    for _ in range(2):  # a second start finds nothing new
        streams.filter_append(hot, "flow > 100", f"{tmp_path}/out", f"{tmp_path}/ck")
    assert [r.offset for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [2]
    lag = topics.consumer_lag(spark.createDataFrame([(0, 1)], "partition int, current_offset bigint"), topics.high_watermarks(batch))
    assert sorted(tuple(r) for r in lag.collect()) == [(0, 1, 3, 2), (1, 0, 8, 8)]
    assert topics.total_lag(lag).first().total_lag == 10


def test_lag_sample(spark):
    rows = [(0, 40, 51, 11), (1, 7, 7, 0), (2, 0, 3, 3)]
    df = spark.createDataFrame(rows, "partition int, current_offset bigint, high_watermark bigint, lag bigint")
    lag = topics.consumer_lag(df.select("partition", "current_offset"), df.select("partition", "high_watermark"))
    assert sorted(tuple(r) for r in lag.collect()) == rows and topics.total_lag(lag).first()[0] == 14


def test_topic_options(spark):
    options = topics.topic_options("h:9092", "t", end="latest", min_partitions=4)
    assert options["endingOffsets"] == "latest" and options["minPartitions"] == "4" and options["subscribe"] == "t"
    assert topics.to_messages(spark.range(1), "id").first().asDict() == {"key": "0", "value": '{"id":0}'}
    window = topics.peek_options("h:9092", "t", {0: 5, 2: 0}, 10)
    assert window["startingOffsets"] == '{"t": {"0": 5, "2": 0}}' and window["endingOffsets"] == '{"t": {"0": 15, "2": 10}}'
    with pytest.raises(PermissionError):
        topics.write_topic(spark.range(1), "h", "t", read_only=True)


def test_stream_results_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="not on a stream"):
        streams.stream_steps(stream, [Step("sort", {"columns": ["ts"]})])
    streams.drop_repeats(stream.select("event_id"), ["event_id"], f"{tmp_path}/d", f"{tmp_path}/ck1")
    assert spark.read.parquet(f"{tmp_path}/d").distinct().count() == events.count()
    streams.changed_totals(streams.throughput(stream, "ts", "1 day", lateness="60 days"), f"{tmp_path}/t", f"{tmp_path}/ck2")
    last = streams.newest_totals(spark.read.parquet(f"{tmp_path}/t"), ["window_start", "window_end"])
    want = streams.throughput(events, "ts", "1 day")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    streams.stream_quality(stream, [Rule("r", "range", "value", {"max": 5})], f"{tmp_path}/q", f"{tmp_path}/ck3")
    judged = spark.read.parquet(f"{tmp_path}/q").agg(F.sum("failed_rows")).first()[0]
    assert judged == events.filter("value > 5").count()


def test_no_key_is_lost_or_repeated(spark, tmp_path):
    """Times far apart, keys without a value, and copies in other batches."""
    rows = [(k, f"2024-0{1 + (7 * k + c) % 9}-01") for k in range(40) for c in range(3)] + [(None, "2024-01-01")] * 3
    spark.createDataFrame(rows, "k int, at string").repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, at string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.drop_repeats(stream, ["k"], f"{tmp_path}/out", f"{tmp_path}/ck")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 41 and out.select("k").distinct().count() == 41 and out.select("batch_id").distinct().count() >= 4


# ---- plans

def test_steps_become_one_scan_with_pushed_filter(spark):
    df = run_steps(table(spark, SF, "orders"), [
        Step("drop_null", {"column": "o_orderdate"}), Step("filter", {"column": "o_orderstatus", "value": "F"}),
        Step("derive", {"column_name": "half", "expression": "o_totalprice / 2"}),
        Step("aggregate", {"group_by": ["o_orderpriority"], "aggregations": [{"column": "half", "function": "SUM"}]})])
    plan = physical(df)
    assert plan.count("FileScan") == 1 and "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate" in plan
    assert "o_custkey" not in plan and plan.count("Exchange") == 1


def test_deduplicate_limits_before_the_shuffle(spark):
    plan = physical(deduplicate(table(spark, SF, "lineitem"), ["l_returnflag"], order_by=["l_orderkey"]))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_rules_and_profile_scan_once(spark):
    orders = table(spark, SF, "orders")
    rules = [Rule(str(i), "range", "o_totalprice", {"min": i}) for i in range(20)] + [Rule("u", "unique", "o_custkey")]
    plan = physical(evaluate(orders, rules))
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
    assert physical(profile(orders, bins=0)).count("FileScan") == 2


def test_no_nested_loops_in_registered_joins(spark):
    from steplake.conformance import load_all
    queries, _ = load_all()
    for name in ("join_range", "join_as_of", "join_as_of_hot_key", "flag_rows_repeated", "ratio_to_mean", "late_runs"):
        plan = physical(queries[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_windows_and_as_of_joins_shuffle_their_rows_once(spark):
    from steplake.conformance import load_all
    queries, _ = load_all()
    # the rows once; the aggregate, the window and the join of one row per stretch
    assert physical(queries["win_running_sum"](spark, SF)).count("Exchange hashpartitioning") <= 4
    plan = physical(queries["join_as_of_hot_key"](spark, SF))
    assert plan.count("Exchange hashpartitioning(__cell") == 2 and "CartesianProduct" not in plan
