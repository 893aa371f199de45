"""Step kinds and step lists on the driver tables."""

from pyspark.sql import functions as F

from steplake.conformance.registry import query, table
from steplake.operators.edits import batch_edit
from steplake.operators.steps import (aggregate, cast_columns, deduplicate, derive, drop_null,
                                      filter_rows, limit_rows, rename, sort_rows)
from steplake.operators.summary import describe, ratio_to_mean
from steplake.plans.step_list import Step, clean_events_steps, clean_orders_steps, run_steps, step_row_counts

LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                             "o_orderpriority")


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_COLUMNS)


def _dated(df):
    """Dates as text, so that both engines print the same."""
    return df.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@query("step_filter_condition", f"{_ORDERS} WHERE o_totalprice > 250000 AND o_orderstatus <> 'P'")
def filter_condition(spark, sf):
    return filter_rows(_orders(spark, sf), "o_totalprice > 250000 AND o_orderstatus <> 'P'")


@query("step_filter_triple", f"{_ORDERS} WHERE o_totalprice >= 300000")
def filter_triple(spark, sf):
    return filter_rows(_orders(spark, sf), column="o_totalprice", operator=">=", value=300000)


@query("step_drop_null", """
SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
                      nullif(o_orderpriority, '5-LOW') AS priority FROM orders)
WHERE status IS NOT NULL AND priority IS NOT NULL""")
def drop_null_rows(spark, sf):
    nulled = _orders(spark, sf).select("o_orderkey", F.expr("nullif(o_orderstatus, 'P') AS status"),
                                       F.expr("nullif(o_orderpriority, '5-LOW') AS priority"))
    return drop_null(nulled, ["status", "priority"])


def _dedup_sql(direction):
    order = ", ".join(f"{c} {direction}" for c in LINE_COLUMNS[2:])
    return f"""
SELECT * EXCLUDE (rn) REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate)
FROM (SELECT {', '.join(LINE_COLUMNS)},
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn
      FROM lineitem) WHERE rn = 1"""


@query("step_dedup_first", _dedup_sql("ASC NULLS LAST"))
def dedup_first(spark, sf):
    return _dated(deduplicate(_lines(spark, sf), LINE_COLUMNS[:2], "first", LINE_COLUMNS[2:]))


@query("step_dedup_last", _dedup_sql("DESC NULLS FIRST"))
def dedup_last(spark, sf):
    return _dated(deduplicate(_lines(spark, sf), LINE_COLUMNS[:2], "last", LINE_COLUMNS[2:]))


@query("step_dedup_rows", "SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem")
def dedup_rows(spark, sf):
    return deduplicate(_lines(spark, sf).select("l_suppkey", "l_linenumber", "l_returnflag"))


_BAND = "CASE WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 ELSE 1 END"


@query("step_derive_case", f"SELECT *, {_BAND} AS price_band FROM ({_ORDERS})")
def derive_case(spark, sf):
    return derive(_orders(spark, sf), "price_band", _BAND)


@query("step_aggregate", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue,
       sum(l_quantity) AS quantity, min(l_discount) AS low, max(l_discount) AS high,
       round(avg(l_quantity), 6) AS mean_quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def aggregate_groups(spark, sf):
    out = aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [
        {"function": "COUNT", "alias": "n"},
        {"column": "l_extendedprice", "function": "SUM", "alias": "revenue"},
        {"column": "l_quantity", "function": "SUM", "alias": "quantity"},
        {"column": "l_discount", "function": "MIN", "alias": "low"},
        {"column": "l_discount", "function": "MAX", "alias": "high"},
        {"column": "l_quantity", "function": "AVG", "alias": "mean_quantity"},
    ])
    return out.withColumns({"revenue": F.round("revenue", 2), "mean_quantity": F.round("mean_quantity", 6)})


@query("step_aggregate_global", """
SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(stddev(o_totalprice), 4) AS spread
FROM orders""")
def aggregate_global(spark, sf):
    out = aggregate(table(spark, sf, "orders"), [], [
        {"function": "COUNT", "alias": "n"},
        {"column": "o_totalprice", "function": "SUM", "alias": "total"},
        {"column": "o_totalprice", "function": "STDDEV", "alias": "spread"}])
    return out.withColumns({"total": F.round("total", 2), "spread": F.round("spread", 4)})


@query("step_aggregate_first_last", """
SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_total,
       arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY o_custkey""")
def aggregate_first_last(spark, sf):
    return aggregate(table(spark, sf, "orders"), ["o_custkey"], [
        {"column": "o_totalprice", "function": "FIRST", "alias": "first_total"},
        {"column": "o_orderstatus", "function": "LAST", "alias": "last_status"}], order_by=["o_orderkey"])


@query("step_aggregate_keys", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def aggregate_keys(spark, sf):
    return aggregate(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("step_rename", "SELECT o_orderkey AS id, o_custkey, o_orderstatus AS status, o_totalprice,"
                      " o_orderpriority FROM orders")
def rename_columns(spark, sf):
    return rename(_orders(spark, sf), {"o_orderkey": "id", "o_orderstatus": "status"})


# text with fractions, blanks, exponents and words, made from the order key
_NUMBER_TEXT = """CASE o_orderkey % 7
  WHEN 0 THEN concat(o_orderkey, '.5') WHEN 1 THEN concat(' ', o_orderkey, ' ')
  WHEN 2 THEN concat('-', o_orderkey, '.49') WHEN 3 THEN concat(o_orderkey, '99999999999')
  WHEN 4 THEN 'abc' WHEN 5 THEN concat(o_orderkey, 'e1') ELSE concat(o_orderkey, '') END AS number_text"""
_DATE_TEXT = """CASE o_orderkey % 4 WHEN 0 THEN '31/12/2025' WHEN 1 THEN '2024'
  WHEN 2 THEN '2024-1-2' ELSE '2024/03/05' END AS date_text"""
_FLAG_TEXT = """CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'F' WHEN 2 THEN '1' ELSE 'maybe' END AS flag_text"""


@query("step_cast", f"""
SELECT o_orderkey, TRY_CAST(number_text AS INTEGER) AS number_text,
       strftime(TRY_CAST(date_text AS DATE), '%Y-%m-%d') AS date_text,
       TRY_CAST(flag_text AS BOOLEAN) AS flag_text, TRY_CAST(half AS BIGINT) AS half,
       TRY_CAST(total AS INTEGER) AS total
FROM (SELECT o_orderkey, {_NUMBER_TEXT}, {_DATE_TEXT}, {_FLAG_TEXT},
             o_orderkey / CAST(2 AS DOUBLE) AS half, CAST(o_totalprice AS DECIMAL(12,2)) AS total FROM orders)""")
def cast_messy(spark, sf):
    messy = table(spark, sf, "orders").selectExpr(
        "o_orderkey", _NUMBER_TEXT, _DATE_TEXT, _FLAG_TEXT, "o_orderkey / CAST(2 AS DOUBLE) AS half",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS total")
    out = cast_columns(messy, {"number_text": "int", "date_text": "date", "flag_text": "bool", "half": "bigint",
                               "total": "integer"})
    return out.withColumn("date_text", F.date_format("date_text", "yyyy-MM-dd"))


@query("step_cast_decimal", """
SELECT o_orderkey, CAST(TRY_CAST(concat(o_totalprice, '56') AS DECIMAL(18,3)) AS DOUBLE) AS price,
       TRY_CAST(concat(o_totalprice, '') AS DOUBLE) AS again
FROM orders""")
def cast_decimal(spark, sf):
    text = table(spark, sf, "orders").selectExpr("o_orderkey", "concat(o_totalprice, '56') AS price",
                                                 "concat(o_totalprice, '') AS again")
    out = cast_columns(text, {"price": "decimal", "again": "double"})
    return out.withColumn("price", F.col("price").cast("double"))


@query("step_sort_limit_offset", f"""
SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders)
ORDER BY status DESC NULLS LAST, o_totalprice NULLS LAST, o_orderkey LIMIT 500 OFFSET 100""")
def sort_limit_offset(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS status", "o_totalprice")
    ordered = sort_rows(df, [{"column": "status", "ascending": False}, "o_totalprice", "o_orderkey"])
    return limit_rows(ordered, 500, 100)


_KEPT = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
  CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 250000 THEN 'mid' ELSE 'high' END AS band
  FROM orders WHERE o_totalprice >= 1000 AND o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL)"""
_FIRSTS = f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, band ORDER BY o_orderkey) AS rn
  FROM {_KEPT}) WHERE rn = 1)"""


@query("clean_orders", f"SELECT * FROM {_FIRSTS}")
def clean_orders(spark, sf):
    return run_steps(table(spark, sf, "orders"), clean_orders_steps()).drop("o_orderdate")


@query("clean_orders_totals", f"SELECT band, round(sum(o_totalprice), 2) AS worth, count(*) AS customers FROM {_FIRSTS} GROUP BY band")
def clean_orders_totals(spark, sf):
    steps = [Step(s.kind, s.params, s.name) for s in clean_orders_steps()]
    return run_steps(table(spark, sf, "orders"), steps).withColumn("worth", F.round("worth", 2))


@query("step_row_counts", f"""
WITH counts AS (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM orders WHERE o_totalprice >= 1000) AS b,
  (SELECT count(*) FROM {_KEPT}) AS c, (SELECT count(*) FROM {_FIRSTS}) AS d)
SELECT 1 AS step, 'filter' AS kind, 'orders worth a call' AS name, a AS rows_in, b AS rows_out FROM counts
UNION ALL SELECT 2, 'drop_null', 'with date and status', b, c FROM counts
UNION ALL SELECT 3, 'derive', 'price band', c, c FROM counts
UNION ALL SELECT 4, 'deduplicate', 'first of customer and band', c, d FROM counts""")
def row_counts(spark, sf):
    return step_row_counts(table(spark, sf, "orders"), clean_orders_steps())


@query("clean_events", """
SELECT event_id AS id, user_id, event_type, value, round(value * 10) + user_id % 7 AS points FROM events
WHERE event_type <> 'view' AND value IS NOT NULL""")
def clean_events(spark, sf):
    return run_steps(table(spark, sf, "events").drop("ts", "props"), clean_events_steps())


# every tenth customer edited, some of them twice, some set to NULL
_EDITS = """SELECT c_custkey AS id, 'c_mktsegment' AS "column", concat('SEG-', c_custkey) AS new_value, 1 AS seq
  FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE 'LAST' END, 2
  FROM customer WHERE c_custkey % 20 = 0
UNION ALL SELECT c_custkey, 'c_acctbal', concat(c_custkey, '.25'), 3 FROM customer WHERE c_custkey % 15 = 0"""


@query("batch_edit", """
SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 15 = 0 THEN c_custkey + 0.25::DOUBLE ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 40 = 0 THEN NULL WHEN c_custkey % 20 = 0 THEN 'LAST'
       WHEN c_custkey % 10 = 0 THEN concat('SEG-', c_custkey) ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def batch_edits(spark, sf):
    customer = table(spark, sf, "customer")
    edits = spark.sql(_EDITS.replace('"column"', "`column`").replace("FROM customer", "FROM {customer}"),
                      customer=customer)
    return batch_edit(customer, edits, "c_custkey")


@query("ratio_to_mean", """
SELECT o_orderkey, round(o_totalprice / (SELECT avg(o_totalprice) FROM orders), 2) AS ratio FROM orders""")
def ratios(spark, sf):
    return ratio_to_mean(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice")


def _describe_sql(column, source):
    return f"""SELECT '{column}' AS "column", count({column}) AS "count", round(avg({column}), 4) AS mean,
  round(stddev_samp({column}), 4) AS std, CAST(min({column}) AS DOUBLE) AS min,
  round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 4) AS q50,
  round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 4) AS q75, CAST(max({column}) AS DOUBLE) AS max FROM {source}"""


@query("describe", "\nUNION ALL ".join(
    _describe_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")))
def describe_lines(spark, sf):
    out = describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})
