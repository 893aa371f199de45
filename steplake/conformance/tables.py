"""Sources, sinks, documents, partitioned tables, guards, workflows and user code on the driver tables.

Whatever a query writes goes to a fresh folder below the shared folder.
"""

import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window, functions as F

from steplake.conformance.registry import query, table
from steplake.functions.sql import run_sql
from steplake.functions.user import Context, combine_groups, map_batches, map_groups, map_groups_arrow, run_script
from steplake.operators import partitioned
from steplake.operators.guards import analyze_columns, estimate_rows, estimate_scan, require_partition_filter
from steplake.operators.nested import expand_json, flatten, infer_types, read_documents
from steplake.plans.workflow import Node, run_workflow
from steplake.session import scratch_path
from steplake.sources.catalog import list_tables, page
from steplake.sources.files import import_table, read_any, read_csv, read_json, read_log_jsonl, read_object_store
from steplake.sources.sinks import export_csv, export_json, export_parquet, save_as_table, write_documents, write_files

# ---- files

_DOCUMENTS = "SELECT doc_id, text, lang, nullif(source, 'src1') AS source, n_chars FROM documents"
_DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _documents(spark, sf):
    return table(spark, sf, "documents").withColumn("source", F.expr("nullif(source, 'src1')"))


@query("csv_round_trip", _DOCUMENTS)
def csv_round_trip(spark, sf):
    """Texts hold line breaks, commas and quotes."""
    path = scratch_path(spark, "csv")
    export_csv(_documents(spark, sf), path)
    return read_csv(spark, path, schema=_DOCUMENT_SCHEMA, multiline=True)


@query("csv_inferred", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark, sf):
    path = scratch_path(spark, "inferred") + ".csv"
    write_files(table(spark, sf, "customer"), path)
    return read_any(spark, path).selectExpr("CAST(c_custkey AS bigint) c_custkey", "c_name", "c_nationkey",
                                            "c_acctbal", "c_mktsegment")


@query("tsv_round_trip", "SELECT * FROM customer")
def tsv_round_trip(spark, sf):
    path = scratch_path(spark, "tsv") + ".tsv"
    customer = table(spark, sf, "customer")
    export_csv(customer, path, sep="\t")
    return read_any(spark, path, schema=customer.schema)


@query("json_round_trip", _DOCUMENTS)
def json_round_trip(spark, sf):
    path = scratch_path(spark, "json") + ".ndjson"
    export_json(_documents(spark, sf), path)
    return read_any(spark, path, schema=_DOCUMENT_SCHEMA)


@query("parquet_round_trip", "SELECT event_id, user_id, event_type, value, props FROM events")
def parquet_round_trip(spark, sf):
    path = scratch_path(spark, "parquet") + ".parquet"
    export_parquet(table(spark, sf, "events").drop("ts"), path)
    return read_any(spark, path)


@query("json_documents", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def json_documents(spark, sf):
    """One JSON array per file: the customers of a nation, at most some thousands of them in a document."""
    path, customer = scratch_path(spark, "arrays"), table(spark, sf, "customer").drop("c_acctbal")
    part = F.floor(F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) / 5000).alias("part")
    arrays = customer.select("*", part).groupBy("c_nationkey", "part").agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))))
    arrays.write.partitionBy("c_nationkey", "part").text(path)
    return read_json(spark, path).selectExpr("c_custkey", "c_name", "CAST(c_nationkey AS int) AS c_nationkey", "c_mktsegment")


@query("import_table", "SELECT count(*) AS row_count, 5 AS column_count FROM customer")
def imported_table(spark, sf):
    name, path = "customer_" + uuid.uuid4().hex, scratch_path(spark, "import")
    export_csv(table(spark, sf, "customer"), f"{path}.csv")
    report = import_table(spark, f"{path}.csv", name, location=f"{path}/table").select("row_count", "column_count")
    rows = report.collect()  # one row
    spark.sql(f"DROP TABLE {name}")
    return table(spark, sf, "customer").limit(1).select(
        F.lit(rows[0].row_count).cast("bigint").alias("row_count"), F.lit(rows[0].column_count).alias("column_count"))


@query("object_store", "SELECT * FROM customer")
def object_store(spark, sf):
    path = scratch_path(spark, "object") + ".parquet"
    export_parquet(table(spark, sf, "customer"), path)
    return read_object_store(spark, path)


@query("export_capped", "SELECT least(500, count(*)) AS n FROM customer")
def export_capped(spark, sf):
    path = scratch_path(spark, "capped")
    customer = table(spark, sf, "customer")
    export_csv(customer, path, limit=500)
    return read_csv(spark, path, schema=customer.schema).agg(F.count(F.lit(1)).alias("n"))


@query("documents_round_trip", """
SELECT CAST(event_id AS VARCHAR) AS _id, nullif(event_type, 'view') AS kind, user_id AS who_id, value AS who_value,
  CASE WHEN event_id % 2 = 0 THEN concat('["', event_type, '","', event_id, '"]') END AS tags FROM events""")
def documents_round_trip(spark, sf):
    path = scratch_path(spark, "documents")
    docs = table(spark, sf, "events").select(
        F.col("event_id").alias("_id"), F.expr("nullif(event_type, 'view') AS kind"),
        F.struct(F.col("user_id").alias("id"), "value").alias("who"),
        F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.col("event_id").cast("string"))).alias("tags"))
    write_documents(docs, path, "overwrite")
    back = read_documents(spark, path)
    return back.withColumnsRenamed({"who.id": "who_id", "who.value": "who_value"})


_COLUMNS = {"benchmark": 2, "conversations": 4, "customer": 5, "documents": 5, "embeddings": 3, "events": 6, "labels": 3,
            "lineitem": 11, "nation": 3, "orders": 6, "pages": 3, "part": 6, "region": 2, "supplier": 4}


@query("list_tables", "\nUNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count, {k} AS column_count FROM {n}"
    for n, k in _COLUMNS.items()))
def listed_tables(spark, sf):
    return list_tables({n: table(spark, sf, n) for n in _COLUMNS}).drop("size_bytes", "updated_at")


@query("preview_page", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 200")
def preview_page(spark, sf):
    return page(table(spark, sf, "customer"), ["c_custkey"], 100, 200)


@query("newest_log_lines", """
SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50""")
def newest_log_lines(spark, sf):
    path = scratch_path(spark, "log")
    table(spark, sf, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.json(path)
    log = read_log_jsonl(spark, path, 50, "ts", "event_id bigint, event_type string, user_id bigint, ts string")
    return log.select("event_id", "event_type", "user_id")


@query("create_insert_view", """
SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def create_insert_view(spark, sf):
    """CREATE TABLE AS, INSERT by name, and a temporary view."""
    name, orders = "orders_" + uuid.uuid4().hex, table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "saved")
    save_as_table(orders.filter("o_orderstatus = 'F'"), name, path=path)
    save_as_table(orders.filter("o_orderstatus <> 'F'").select("o_orderstatus", "o_orderkey"), name, "append")
    spark.table(name).createOrReplaceTempView(f"{name}_view")
    counted = run_sql(spark, f"SELECT o_orderstatus, count(*) AS n FROM {name}_view GROUP BY 1", None)
    spark.catalog.dropTempView(f"{name}_view")
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the plan reads them
    return counted


# ---- nested data

@query("flatten_docs", """
SELECT event_id, user_id AS who_id, event_type AS who_what_kind, value AS who_what_size,
  concat('["', event_type, '","x"]') AS tags FROM events""")
def flatten_docs(spark, sf):
    nested = table(spark, sf, "events").select(
        "event_id", F.struct(F.col("user_id").alias("id"), F.struct(
            F.col("event_type").alias("kind"), F.col("value").alias("size")).alias("what")).alias("who"),
        F.array("event_type", F.lit("x")).alias("tags"))
    return flatten(nested, "_")


@query("expand_json_props", """
SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""")
def expand_json_props(spark, sf):
    return expand_json(table(spark, sf, "events").select("event_id", "user_id", "props"), "props", sep="_")


@query("infer_json_schema", """
SELECT name, CASE WHEN (SELECT count(*) FROM events) > 0 THEN data_type END AS data_type FROM (VALUES
 ('a.id', 'BIGINT'), ('a.b.kind', 'VARCHAR'), ('late', 'DOUBLE'), ('flag', 'BOOLEAN'), ('list', 'VARCHAR')) t(name, data_type)""")
def infer_json_schema(spark, sf):
    docs = table(spark, sf, "events").select("event_id", F.to_json(F.struct(
        F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("kind")).alias("b")).alias("a"),
        F.when(F.col("event_id") > 500, F.col("value") + 0.125).alias("late"), (F.col("user_id") > 3).alias("flag"),
        F.array("event_type").alias("list"))).alias("doc"))
    return infer_types(docs, "doc", "event_id")


# ---- partitioned tables and snapshots

_PLAIN = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").drop("o_orderdate")


@query("merge_upsert", f"""
SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 35 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus) FROM ({_PLAIN})""")
def merge_upsert(spark, sf):
    """Incoming rows change other rows of the table, add new ones, and move some to another partition."""
    orders, path = _orders(spark, sf), scratch_path(spark, "merge")
    partitioned.overwrite(orders.filter("o_orderkey % 3 <> 0"), path, ["o_orderstatus"])
    changed = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))
    moved = F.when(F.col("o_orderkey") % 35 == 0, "F").otherwise(F.col("o_orderstatus"))
    incoming = orders.filter("o_orderkey % 3 = 0 OR o_orderkey % 5 = 0").withColumns({"o_totalprice": changed, "o_orderstatus": moved})
    partitioned.merge(incoming, path, ["o_orderkey"], ["o_orderstatus"])
    return partitioned.read_table(spark, path, orders.schema)


@query("append_overwrite_counts", """
SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS first, (SELECT count(*) FROM orders) AS second,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS third""")
def append_overwrite_counts(spark, sf):
    orders, path, counts = _orders(spark, sf), scratch_path(spark, "writes"), []
    for write, rows in ((partitioned.overwrite, orders.filter("o_orderkey % 2 = 0")), (partitioned.append, orders.filter("o_orderkey % 2 = 1")),
                        (partitioned.overwrite, orders.filter("o_orderstatus = 'F'"))):
        write(rows, path, ["o_orderpriority"])
        counts.append(partitioned.read_table(spark, path, orders.schema).count())
    return orders.select(*[F.lit(n).cast("bigint").alias(name) for n, name in zip(counts, ("first", "second", "third"))]).limit(1)


def _three_snapshots(spark, sf):
    orders, path = _orders(spark, sf), scratch_path(spark, "snapshots")
    for number, condition in enumerate(("o_orderkey % 2 = 0", "true", "o_orderstatus = 'F'"), 1):
        partitioned.write_snapshot(orders.filter(condition), path, number)
    return orders, path


@query("table_history", """
SELECT 1 AS snapshot, count(*) AS total_rows FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 2, count(*) FROM orders UNION ALL SELECT 3, count(*) FROM orders WHERE o_orderstatus = 'F'""")
def table_history(spark, sf):
    return partitioned.snapshot_rows(spark, _three_snapshots(spark, sf)[1])


@query("as_of_read", f"{_PLAIN} WHERE o_totalprice > 100000")
def as_of_read(spark, sf):
    orders, path = _three_snapshots(spark, sf)
    return partitioned.read_snapshot(spark, path, orders.schema, 2).filter("o_totalprice > 100000")


@query("vacuum_retains", """
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n, count(*) AS n_before FROM orders""")
def vacuum_retains(spark, sf):
    """The newest two snapshots stay readable."""
    orders, path = _three_snapshots(spark, sf)
    partitioned.drop_snapshots(spark, path, 2)
    last, before = (partitioned.read_snapshot(spark, path, orders.schema, n) for n in (None, 2))
    return last.agg(F.count(F.lit(1)).alias("n")).select("n", before.agg(F.count(F.lit(1))).scalar().alias("n_before"))


@query("compact_rows", "SELECT event_id, user_id, event_type, value, props FROM events")
def compact_rows(spark, sf):
    events, path = table(spark, sf, "events").drop("ts"), scratch_path(spark, "compact")
    for part in range(3):
        partitioned.append(events.filter(F.col("event_id") % 3 == part), path, ["event_type"])
    report = partitioned.compact(spark, path, events.schema, ["event_type"])
    if not report["new_files_count"] < report["previous_files_count"]:
        raise AssertionError(f"compaction left {report['new_files_count']} of {report['previous_files_count']} files")
    return partitioned.read_table(spark, path, events.schema)


@query("file_statistics", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def file_statistics(spark, sf):
    events, path = table(spark, sf, "events").drop("ts"), scratch_path(spark, "files")
    partitioned.overwrite(events, path, ["event_type"])
    return partitioned.files(spark, path, events.schema, ["event_type"]).groupBy("event_type").agg(F.sum("rows").alias("n"))


_DAILY = """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, value FROM events"""
# the days from the eighth one on, and all but the last two
_RANGE = "(SELECT strftime(min(ts) + INTERVAL 7 DAY, '%Y-%m-%d') AS a, strftime(max(ts) - INTERVAL 2 DAY, '%Y-%m-%d') AS b FROM events)"


def _daily(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


def _backfilled(spark, sf):
    daily, path = _daily(spark, sf), scratch_path(spark, "backfill")
    day = "yyyy-MM-dd"
    first, last = table(spark, sf, "events").agg(F.date_format(F.min("ts") + F.expr("INTERVAL 7 DAY"), day),
                                                 F.date_format(F.max("ts") - F.expr("INTERVAL 2 DAY"), day)).first()
    partitioned.overwrite(daily, path, ["day"])
    runs = partitioned.backfill(daily.withColumn("value", F.col("value") + 1000), path, "day", first, last)
    return partitioned.read_table(spark, path, daily.schema), runs


@query("backfill_days", f"""
SELECT event_id, day, CASE WHEN day BETWEEN a AND b THEN value + 1000 ELSE value END AS value FROM ({_DAILY}), {_RANGE}""")
def backfill_days(spark, sf):
    return _backfilled(spark, sf)[0]


@query("backfill_runs", f"""
SELECT d AS backfill_date, 'success' AS status, count(event_id) AS rows_processed
FROM (SELECT strftime(unnest(generate_series(CAST(a AS DATE), CAST(b AS DATE), INTERVAL 1 DAY)), '%Y-%m-%d') AS d FROM {_RANGE})
LEFT JOIN ({_DAILY}) ON day = d GROUP BY 1""")
def backfill_runs(spark, sf):
    return _backfilled(spark, sf)[1].select("backfill_date", "status", "rows_processed")


@query("overwrite_partitions", f"""
SELECT event_id, day, value FROM ({_DAILY}) WHERE day NOT IN ('2024-01-03', '2024-01-04') OR value > 5""")
def overwrite_partitions(spark, sf):
    daily, path = _daily(spark, sf), scratch_path(spark, "partitions")
    partitioned.overwrite(daily, path, ["day"])
    partitioned.overwrite_partitions(daily.filter("day IN ('2024-01-03', '2024-01-04') AND value > 5"), path, ["day"])
    return partitioned.read_table(spark, path, daily.schema)


# ---- guards

@query("estimate_scan", "SELECT count(*) AS n, true AS some_bytes FROM lineitem")
def scan_estimate(spark, sf):
    estimate = estimate_scan(table(spark, sf, "lineitem").filter("l_quantity > 10"), count_rows=True)
    return spark.createDataFrame([(estimate.rows, estimate.size_bytes > 0)], "n bigint, some_bytes boolean")


@query("estimate_rows", """
SELECT count(*) FILTER (WHERE l_quantity > 40 AND l_shipdate < DATE '1996-01-01') AS n, true AS range_near, true AS join_near FROM lineitem""")
def rows_estimate(spark, sf):
    """The optimiser's row counts by column histograms lie within a factor of two of the true ones, without a file list or a run."""
    name, path = "lines_" + uuid.uuid4().hex, scratch_path(spark, "analysed")
    save_as_table(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.to_date("l_shipdate").alias("l_shipdate")), name, path=path)
    save_as_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), f"{name}_o", path=f"{path}-orders")
    analyze_columns(spark, name, ["l_orderkey", "l_quantity", "l_shipdate"])
    analyze_columns(spark, f"{name}_o", ["o_orderkey", "o_totalprice"])
    chosen = spark.table(name).filter("l_quantity > 40 AND l_shipdate < DATE '1996-01-01'")
    joined = spark.table(name).join(spark.table(f"{name}_o").filter("o_totalprice > 200000"), F.col("l_orderkey") == F.col("o_orderkey"))
    near = []
    for query_ in (chosen, joined):
        estimate, true = estimate_rows(query_), query_.count()
        near.append(estimate is not None and true / 2 <= estimate <= 2 * max(true, 1))
    out = chosen.agg(F.count(F.lit(1)).alias("n"), F.lit(near[0]).alias("range_near"), F.lit(near[1]).alias("join_near")).first()
    for suffix in ("", "_o"):
        spark.sql(f"DROP TABLE {name}{suffix}")
    return spark.createDataFrame([tuple(out)], "n bigint, range_near boolean, join_near boolean")


@query("partition_guard", f"""
SELECT count(*) AS n, true AS fine, true AS joined, false AS loose, false AS other FROM ({_DAILY}) WHERE day = '2024-01-05'""")
def partition_guard(spark, sf):
    """Equality on the partition passes, beside other filters and joins too; inequality and alternatives don't."""
    path, daily = scratch_path(spark, "guard"), _daily(spark, sf)
    partitioned.overwrite(daily, path, ["day"])
    stored, events = partitioned.read_table(spark, path, daily.schema), table(spark, sf, "events").select("event_id", "user_id")
    one_day = stored.filter("day = '2024-01-05'")
    asked = {"fine": one_day, "joined": one_day.filter("day > '2023' AND day < '2025'").join(events, "event_id"),
             "loose": stored.filter("value > 3 AND day <> '2024-01-05'"), "other": stored.filter("day = '2024-01-05' OR day > '2024-01-07'")}
    return one_day.agg(F.count(F.lit(1)).alias("n")).select("n", *[F.lit(require_partition_filter(df, ["day"])[0]).alias(k) for k, df in asked.items()])


# ---- workflows

@query("workflow_branching", """
SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(big) AS biggest FROM
 (SELECT * FROM orders WHERE o_orderstatus = 'F') JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS big FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON k = o_custkey
GROUP BY 1""")
def workflow_branching(spark, sf):
    """One node feeds two branches; a SQL node reads three others."""
    path = scratch_path(spark, "workflow") + ".parquet"
    nodes = [
        Node("orders", "source", {"table": "orders"}), Node("people", "source", {"table": "customer"}),
        Node("done", "filter", {"condition": "o_orderstatus = 'F'", "requires": ["o_orderstatus"]}),
        Node("solvent", "filter", {"condition": "c_acctbal > 0"}),
        Node("check", "quality_assert", {"rule": "not_null", "column": "o_custkey"}),
        Node("best", "transform_sql", {"sql": "SELECT o_custkey AS k, max(o_totalprice) AS big FROM __input__ GROUP BY 1"}),
        Node("joined", "transform_sql", {"sql": """
            SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(big) AS biggest
            FROM __input__ JOIN __input_solvent__ ON o_custkey = c_custkey
            LEFT JOIN __input_best__ ON k = o_custkey GROUP BY 1"""}),
        Node("out", "destination", {"path": path}),
    ]
    edges = [("orders", "done"), ("people", "solvent"), ("done", "check"), ("done", "best"), ("check", "joined"),
             ("solvent", "joined"), ("best", "joined"), ("joined", "out")]
    result = run_workflow(spark, nodes, edges, {"orders": table(spark, sf, "orders"), "customer": table(spark, sf, "customer")})
    if not result.success:
        raise RuntimeError(result.error)
    return spark.read.parquet(path)


# ---- user code

@query("map_in_pandas", "SELECT event_id, round(value * 2 + 1, 2) AS scaled, length(props) AS size FROM events")
def map_in_pandas(spark, sf):
    def scale(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": batch["event_id"], "scaled": (batch["value"] * 2 + 1).round(2),
                             "size": batch["props"].str.len()})
    return map_batches(table(spark, sf, "events").select("event_id", "value", "props"), scale,
                       "event_id bigint, scaled double, size bigint")


_SPREAD = """SELECT user_id, {part} AS part, count(*) AS n, round(max(value) - min(value), 2) AS spread FROM events
GROUP BY 1, 2"""


@query("apply_in_pandas", _SPREAD.format(part="CAST(floor(dayofyear(ts) / 10) AS BIGINT)"))
def apply_in_pandas(spark, sf):
    """One group per user and ten days, handed over in batches."""
    def spread(key, batches):
        n, low, high = 0, float("inf"), float("-inf")
        for batch in batches:
            n, low, high = n + len(batch), min(low, batch["value"].min()), max(high, batch["value"].max())
        yield pd.DataFrame({"user_id": [key[0]], "part": [key[1]], "n": [n], "spread": [round(high - low, 2)]})
    events = table(spark, sf, "events").select("user_id", F.floor(F.dayofyear("ts") / 10).alias("part"), "value")
    return map_groups(events, ["user_id", "part"], spread, "user_id bigint, part bigint, n bigint, spread double")


@query("apply_in_arrow", _SPREAD.format(part="strftime(ts, '%Y-%m-%d')"))
def apply_in_arrow(spark, sf):
    """One group per user and day, as Arrow batches."""
    def spread(key, batches):
        n, low, high = 0, float("inf"), float("-inf")
        for batch in batches:
            limits = pc.min_max(batch["value"]).as_py()
            n, low, high = n + batch.num_rows, min(low, limits["min"]), max(high, limits["max"])
        yield pa.RecordBatch.from_pydict({"user_id": [key[0]], "part": [key[1]], "n": [n], "spread": [round(high - low, 2)]})
    events = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("part"), "value")
    return map_groups_arrow(events, ["user_id", "part"], spread, "user_id bigint, part string, n bigint, spread double")


@query("combine_in_pandas", """
SELECT event_type, count(*) AS n, round(sum(value * value), 4) AS squares FROM events GROUP BY 1""")
def combine_in_pandas(spark, sf):
    """Five event types share all rows: batches are reduced before the shuffle."""
    def partial(batch: pd.DataFrame) -> pd.DataFrame:
        squares = batch["value"] ** 2
        out = squares.groupby(batch["event_type"]).agg(["size", "sum"]).reset_index()
        return out.set_axis(["event_type", "n", "squares"], axis=1)

    def merge(parts):
        return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("squares"), 4).alias("squares"))
    return combine_groups(table(spark, sf, "events").select("event_type", "value"), ["event_type"], partial,
                          "event_type string, n bigint, squares double", merge)


@query("user_script", """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1""")
def user_script(spark, sf):
    context = Context(spark, {"orders": table(spark, sf, "orders")}, {"floor": 1000})
    made = {}

    def script(ctx):
        rows = ctx.sql("SELECT * FROM {orders}").filter(F.col("o_totalprice") > ctx.params["floor"])
        ctx.log("columns:", len(rows.columns))
        made["result"] = rows.groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        return made["result"]
    run_script(context, script)
    return made["result"]


@query("user_tables", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2""")
def user_tables(spark, sf):
    """A script reads a table, writes one, adds to it and reads it back."""
    context = Context(spark, {"orders": table(spark, sf, "orders")}, location=scratch_path(spark, "script"))
    name = "counts_" + uuid.uuid4().hex

    def script(ctx):
        for status, mode in (("F", "overwrite"), ("O", "append")):
            counted = ctx.read_table("orders").filter(F.col("o_orderstatus") == status).groupBy("o_orderpriority", "o_orderstatus")
            ctx.write_table(name, counted.agg(F.count(F.lit(1)).alias("n")), mode)
    run_script(context, script)
    rows = context.read_table(name)
    rows.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return rows


@query("workflow_python", """
SELECT event_id, value * 2 AS doubled FROM events WHERE value > 3 UNION ALL SELECT event_id, value * 2 FROM events WHERE value > 3""")
def workflow_python(spark, sf):
    """A node in Python, and a destination that is added to by a second run."""
    path = scratch_path(spark, "workflow") + ".parquet"
    nodes = [Node("events", "source", {"table": "events"}),
             Node("double", "python", {"function": lambda df, least: df.filter(F.col("value") > least).select(
                 "event_id", (F.col("value") * 2).alias("doubled")), "params": {"least": 3}}),
             Node("out", "destination", {"path": path, "mode": "append"})]
    for _ in range(2):
        result = run_workflow(spark, nodes, [("events", "double"), ("double", "out")], {"events": table(spark, sf, "events")})
        if not result.success:
            raise RuntimeError(result.error)
    return spark.read.parquet(path)
