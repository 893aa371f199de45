"""Joins, aggregates, windows, sets, subqueries and scalar functions on the driver tables."""

from pyspark.sql import functions as F

from steplake.conformance.registry import query, table
from steplake.functions.sql import run_sql
from steplake.operators.bags import except_all, intersect_all
from steplake.operators.joins import as_of_join, full_join, overlap_join, range_join
from steplake.operators.steps import deduplicate, sample_rows
from steplake.operators.stretches import ROWS
from steplake.operators.summary import quantiles
from steplake.operators.windows import framed, running


def _sql(name, oracle, text=None, tables=("orders",)):
    """A query whose Spark side is SQL text too: the whole result, no row limit."""
    spark_text = text or oracle

    @query(name, oracle)
    def run(spark, sf):
        return run_sql(spark, spark_text, None, **{t: table(spark, sf, t) for t in tables})
    return run


def _braced(text, *tables):
    for t in tables:
        text = text.replace(f" {t} ", f" {{{t}}} ").replace(f" {t}\n", f" {{{t}}}\n").replace(f" {t})", f" {{{t}}})")
    return text


def _same_sql(name, text, *tables):
    """The same text in both engines; each table name is followed by a blank, a line end or a bracket."""
    return _sql(name, text, _braced(text + " ", *tables), tables)


# ---- results through free SQL

_same_sql("run_sql", """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_totalprice BETWEEN 50000 AND 400000 AND (o_orderpriority LIKE '%HIGH' OR o_orderpriority IN ('5-LOW'))
  AND NOT (o_orderstatus = 'P') GROUP BY o_orderpriority """, "orders")


@query("run_sql_limited", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def run_sql_limited(spark, sf):
    return run_sql(spark, "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey", 1000,
                   orders=table(spark, sf, "orders"))


@query("predicates", """
SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'none' WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size
FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-') AND o_orderstatus IS NOT NULL""")
def predicates(spark, sf):
    return (table(spark, sf, "orders").filter(F.col("o_orderpriority").rlike("^[12]-") & F.col("o_orderstatus").isNotNull())
            .select("o_orderkey", F.when(F.col("o_totalprice").isNull(), "none")
                    .when(F.col("o_totalprice") > 200000, "big").otherwise("small").alias("size")))


# ---- joins

def _join(spark, sf, how):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, how)


_JOIN_SQL = """SELECT {columns} FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders {o}) {how} JOIN
 (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem) ON o_orderkey = l_orderkey"""


@query("join_inner", _JOIN_SQL.format(columns="*", how="INNER", o=""))
def join_inner(spark, sf):
    return _join(spark, sf, "inner")


@query("join_left", _JOIN_SQL.format(columns="*", how="LEFT", o=""))
def join_left(spark, sf):
    return _join(spark, sf, "left")


@query("join_right", "SELECT n_name, c_custkey, c_acctbal FROM nation RIGHT JOIN customer"
                     " ON n_nationkey = c_nationkey AND n_regionkey < 3")
def join_right(spark, sf):
    nation = table(spark, sf, "nation").filter("n_regionkey < 3")
    customer = table(spark, sf, "customer")
    return nation.join(customer, nation.n_nationkey == customer.c_nationkey, "right").select(
        "n_name", "c_custkey", "c_acctbal")


@query("join_full", """
SELECT coalesce(c_custkey, o_custkey) AS custkey, c_name, o_orderkey FROM
 (SELECT c_custkey + 100 AS c_custkey, c_name FROM customer) FULL JOIN
 (SELECT o_custkey, o_orderkey FROM orders) ON c_custkey = o_custkey""")
def join_full(spark, sf):
    """Shifted customer keys leave rows without a partner on both sides."""
    customer = table(spark, sf, "customer").select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return full_join(orders, customer, ["o_custkey"], ["c_custkey"]).select(
        F.coalesce("c_custkey", "o_custkey").alias("custkey"), "c_name", "o_orderkey")


@query("join_semi", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE EXISTS"
                    " (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_semi(spark, sf):
    return _join(spark, sf, "left_semi")


@query("join_anti", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT EXISTS"
                    " (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, sf):
    return _join(spark, sf, "left_anti")


@query("join_star", """
SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def join_star(spark, sf):
    """Four tables; the small sides are broadcast by Spark where their size allows."""
    by_supplier = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"))
    supplier, nation, region = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (by_supplier.join(supplier, by_supplier.l_suppkey == supplier.s_suppkey)
            .join(nation, F.col("s_nationkey") == nation.n_nationkey)
            .join(region, F.col("n_regionkey") == region.r_regionkey)
            .groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("revenue"), 4).alias("revenue")))


_SPANS = """SELECT user_id AS span_user, CAST(ts AS DATE) AS span_day, min(ts) AS span_start, max(ts) AS span_end
  FROM {events} WHERE event_type = 'purchase' GROUP BY 1, 2"""


@query("join_range", f"""
SELECT event_id, user_id, strftime(span_day, '%Y-%m-%d') AS span_day FROM events
JOIN ({_SPANS.format(events='events')}) ON user_id = span_user AND ts BETWEEN span_start AND span_end""")
def join_range(spark, sf):
    """Events between a user's first and last purchase of a day: at most one span per event."""
    events = table(spark, sf, "events")
    spans = run_sql(spark, _SPANS, None, events=events).withColumnRenamed("span_user", "user_id")
    pairs = range_join(events.select("event_id", "user_id", "ts"), spans, "ts", "span_start", "span_end", 86400,
                       ["user_id"])
    return pairs.select("event_id", "user_id", F.date_format("span_day", "yyyy-MM-dd").alias("span_day"))


_SESSIONS_SQL = """(SELECT user_id, event_id, ts AS {p}_start, ts + to_minutes(CAST({length} AS BIGINT)) AS {p}_end FROM events WHERE event_type = '{kind}')"""


@query("join_overlap", f"""
SELECT l.event_id, r.event_id AS other_id FROM {_SESSIONS_SQL.format(p="l", length="30 + event_id % 200", kind="purchase")} l
JOIN {_SESSIONS_SQL.format(p="r", length="CASE WHEN event_id % 50 = 0 THEN 9000 ELSE event_id % 90 END", kind="view")} r
  ON l.user_id % 2 = r.user_id % 2 AND l.l_start <= r.r_end AND r.r_start <= l.l_end""")
def join_overlap(spark, sf):
    """Intervals of two kinds, some very long, by half of the users; small cells, so that even small tables are cut."""
    events = table(spark, sf, "events").withColumn("half", F.col("user_id") % 2)
    left = events.filter("event_type = 'purchase'").selectExpr(
        "event_id", "half", "ts AS l_start", "ts + make_dt_interval(0, 0, CAST(30 + event_id % 200 AS int)) AS l_end")
    right = events.filter("event_type = 'view'").selectExpr(
        "event_id AS other_id", "half", "ts AS r_start",
        "ts + make_dt_interval(0, 0, CAST(CASE WHEN event_id % 50 = 0 THEN 9000 ELSE event_id % 90 END AS int)) AS r_end")
    rows = min(ROWS, 1 + events.count() // 16)
    return overlap_join(left, right, "l_start", "l_end", "r_start", "r_end", ["half"], rows).select("event_id", "other_id")


def _as_of(spark, sf, key):
    events = table(spark, sf, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", (F.col("user_id") % 2).alias("half"))
    right = (events.filter("event_type = 'view'").withColumn("half", F.col("user_id") % 2)
             .groupBy(key, F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id")))
    return as_of_join(left, right, "ts", [key], right_on="view_ts").select("event_id", key, "view_id")


def _as_of_sql(key):
    return f"""SELECT event_id, l.{key}, view_id FROM
  (SELECT event_id, ts, user_id, user_id % 2 AS half FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN
  (SELECT {key}, ts AS view_ts, max(event_id) AS view_id FROM (SELECT *, user_id % 2 AS half FROM events)
   WHERE event_type = 'view' GROUP BY 1, 2) r ON l.{key} = r.{key} AND l.ts >= r.view_ts"""


@query("join_as_of", _as_of_sql("user_id"))
def join_as_of(spark, sf):
    return _as_of(spark, sf, "user_id")


@query("join_as_of_hot_key", _as_of_sql("half"))
def join_as_of_hot_key(spark, sf):
    """Two keys share all rows."""
    return _as_of(spark, sf, "half")


# ---- aggregates

@query("agg_distinct_filter_having", """
SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
  round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS returned
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 590""")
def agg_distinct_filter_having(spark, sf):
    return (table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), 2).alias("returned"),
        F.count(F.lit(1)).alias("n")).filter("n > 590").drop("n"))


_GROUPED = """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_extendedprice), 2) AS total,
  CAST(grouping(l_returnflag) AS INTEGER) AS all_flags FROM lineitem
GROUP BY {groups} """
for _name, _groups in (("agg_rollup", "ROLLUP (l_returnflag, l_linestatus, l_linenumber)"),
                       ("agg_cube", "CUBE (l_returnflag, l_linestatus, l_linenumber)"),
                       ("agg_grouping_sets",
                        "GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), (l_linestatus, l_linenumber, l_returnflag), ())")):
    _same_sql(_name, _GROUPED.format(groups=_groups), "lineitem")


@query("agg_quantiles_tail", """
SELECT 0.0001::DOUBLE AS probability, round(quantile_cont(v, 0.0001), 4) AS quantile FROM {v}
UNION ALL SELECT 0.3, round(quantile_cont(v, 0.3), 4) FROM {v} UNION ALL SELECT 0.9999, round(quantile_cont(v, 0.9999), 4) FROM {v}""".format(
    v="(SELECT CASE WHEN l_orderkey = 1 THEN 1e12::DOUBLE WHEN l_linenumber = 3 THEN 7.0::DOUBLE ELSE l_extendedprice END AS v FROM lineitem)"))
def agg_quantiles_tail(spark, sf):
    """A few values far out and one value in a seventh of the rows."""
    value = F.when(F.col("l_orderkey") == 1, 1e12).when(F.col("l_linenumber") == 3, 7.0).otherwise(F.col("l_extendedprice"))
    tail = quantiles(table(spark, sf, "lineitem").select(value.alias("v")), "v", [0.0001, 0.3, 0.9999])
    return tail.withColumn("quantile", F.round("quantile", 4))


@query("agg_quantiles", """
SELECT l_returnflag, probability, round(CASE probability WHEN 0.05 THEN a WHEN 0.5 THEN b ELSE c END, 6) AS quantile FROM
 (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.5) AS b,
         quantile_cont(l_extendedprice, 0.99) AS c FROM lineitem GROUP BY 1),
 (SELECT unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.99::DOUBLE]) AS probability)""")
def agg_quantiles(spark, sf):
    return quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.05, 0.5, 0.99], ["l_returnflag"]).withColumn(
        "quantile", F.round("quantile", 6))


# ---- windows: a handful of event types share all rows

@query("win_rank", """
SELECT event_id, event_type, row_number() OVER w AS position, rank() OVER (PARTITION BY event_type ORDER BY value) AS place,
  dense_rank() OVER (PARTITION BY event_type ORDER BY value) AS level
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def win_rank(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    ranked = running(events, ["event_type"], ["value"], rank="place", dense_rank="level")
    out = running(ranked, ["event_type"], ["ts", "event_id"], row_number="position")
    return out.drop("ts", "value")


@query("win_lag_lead", """
SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, lag(event_id) OVER w AS before_id
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def win_lag_lead(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return running(events, ["event_type"], ["ts", "event_id"],
                   lags={"before": "value", "before_id": "event_id"}, leads={"after": "value"}).select(
        "event_id", "before", "after", "before_id")


@query("win_running_sum", """
SELECT event_id, CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY event_type ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto FROM events""")
def win_running_sum(spark, sf):
    events = table(spark, sf, "events").selectExpr("event_id", "event_type", "ts", "CAST(value AS DECIMAL(12,2)) AS value")
    out = running(events, ["event_type"], ["ts", "event_id"], sums={"upto": "value"})
    return out.select("event_id", F.col("upto").cast("double").alias("upto"))


@query("win_frame", """
SELECT event_id, round(avg(value) OVER w, 6) AS smooth, max(value) OVER w AS top, count(*) OVER w AS n
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def win_frame(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    out = framed(events, ["event_type"], ["ts", "event_id"], None, 2, 1, {
        "smooth": F.avg("value"), "top": F.max("value"), "n": F.count(F.lit(1))})
    return out.select("event_id", F.round("smooth", 6).alias("smooth"), "top", "n")


# a third of the rows has one key and comes in one second, and every tenth has no time
_BURST_SQL = """(SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN 'busy' ELSE event_type END AS k,
  CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' ELSE ts END AS moment,
  CASE WHEN event_id % 3 = 0 THEN 5.0 ELSE value END AS level FROM events)"""


def _burst(spark, sf):
    """The events with a busy key, and how many rows a stretch gets so that even small tables are cut."""
    events = table(spark, sf, "events").selectExpr(
        "event_id", "value", "CASE WHEN event_id % 3 = 0 THEN 'busy' ELSE event_type END AS k",
        "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN TIMESTAMP_NTZ '2024-01-02 03:04:05' ELSE ts END AS moment",
        "CASE WHEN event_id % 3 = 0 THEN 5.0D ELSE value END AS level")
    return events, min(ROWS, 1 + events.count() // 16)


@query("win_burst", f"""
SELECT event_id, row_number() OVER w AS position, CAST(sum(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE) AS upto,
  lag(event_id) OVER w AS before_id, lead(value) OVER w AS after
FROM {_BURST_SQL} WINDOW w AS (PARTITION BY k ORDER BY moment NULLS LAST, event_id)""")
def win_burst(spark, sf):
    events, rows = _burst(spark, sf)
    events = events.withColumn("amount", F.col("value").cast("decimal(12,2)"))
    out = running(events, ["k"], ["moment", "event_id"], row_number="position", sums={"upto": "amount"}, lags={"before_id": "event_id"},
                  leads={"after": "value"}, rows=rows)
    return out.select("event_id", "position", F.col("upto").cast("double").alias("upto"), "before_id", "after")


@query("win_rank_burst", f"""
SELECT event_id, rank() OVER w AS place, dense_rank() OVER w AS step FROM {_BURST_SQL} WINDOW w AS (PARTITION BY k ORDER BY level)""")
def win_rank_burst(spark, sf):
    events, rows = _burst(spark, sf)
    return running(events, ["k"], ["level"], rank="place", dense_rank="step", rows=rows).select("event_id", "place", "step")


@query("join_as_of_burst", f"""
SELECT l.event_id, max(r.event_id) AS last_id FROM (SELECT * FROM {_BURST_SQL} WHERE event_id % 2 = 1) l
ASOF LEFT JOIN (SELECT k, moment, max(event_id) AS event_id FROM {_BURST_SQL} WHERE event_id % 2 = 0 AND moment IS NOT NULL GROUP BY k, moment) r
  ON l.k = r.k AND l.moment >= r.moment GROUP BY l.event_id""")
def join_as_of_burst(spark, sf):
    events, rows = _burst(spark, sf)
    left = events.filter("event_id % 2 = 1").select("event_id", "k", "moment")
    right = events.filter("event_id % 2 = 0").select("k", F.col("moment").alias("r_at"), F.col("event_id").alias("last_id"))
    return as_of_join(left, right, "moment", ["k"], right_on="r_at", rows=rows).select("event_id", "last_id")


_same_sql("win_frame_sql", """SELECT o_orderkey, round(avg(o_totalprice) OVER w, 6) AS smooth, CAST(ntile(2) OVER w2 AS BIGINT) AS half,
  first_value(o_orderkey) OVER w2 AS first_key, round(percent_rank() OVER w2, 6) AS pct
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING),
  w2 AS (PARTITION BY o_custkey ORDER BY o_orderkey)""", "orders")


@query("topk_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def topk_per_group(spark, sf):
    """The filter on the rank reaches the map side, so a busy customer sends three rows per task."""
    text = """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn <= 3"""
    return run_sql(spark, text, None, orders=table(spark, sf, "orders"))


@query("qualify_last", """
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def qualify_last(spark, sf):
    """QUALIFY is written as a deduplicate step."""
    return deduplicate(table(spark, sf, "events"), ["user_id", "event_type"], "last", ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value")


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def top_orders(spark, sf):
    return (table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
            .orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(25))


# ---- sets and subqueries

# one value holds a third of the rows of either side, NULL another part
_BAGS = {side: f"""SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_linenumber % 2 = {p} THEN 'busy' ELSE concat('s', l_suppkey) END AS k,
  l_linenumber % 2 AS n FROM {{lineitem}} WHERE l_partkey % 4 <> {p}""" for p, side in enumerate("lr")}


def _bags(spark, sf):
    return [spark.sql(text, lineitem=table(spark, sf, "lineitem")) for text in _BAGS.values()]


@query("set_intersect_all", " INTERSECT ALL ".join(text.format(lineitem="lineitem") for text in _BAGS.values()))
def set_intersect_all(spark, sf):
    return intersect_all(*_bags(spark, sf))


@query("set_except_all", " EXCEPT ALL ".join(text.format(lineitem="lineitem") for text in _BAGS.values()))
def set_except_all(spark, sf):
    return except_all(*_bags(spark, sf))


_same_sql("set_union", """SELECT c_nationkey AS nkey FROM customer UNION SELECT s_nationkey FROM supplier
UNION ALL SELECT n_nationkey FROM nation """, "customer", "supplier", "nation")
_same_sql("set_intersect", """SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT
SELECT c_custkey FROM customer WHERE c_acctbal > 5000 """, "orders", "customer")
_same_sql("set_except", """SELECT c_custkey AS custkey FROM customer EXCEPT
SELECT o_custkey FROM orders WHERE o_totalprice > 300000 """, "orders", "customer")


@query("set_all", """
SELECT l_suppkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity < 10 INTERSECT ALL
SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_discount < 0.03""")
def set_all(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.filter("l_quantity < 10").selectExpr("l_suppkey AS k", "l_linenumber AS n").intersectAll(
        lines.filter("l_discount < 0.03").selectExpr("l_suppkey AS k", "l_linenumber AS n"))


_same_sql("subquery_scalar", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders )""", "orders")
_same_sql("subquery_in", """SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) """, "customer", "orders")
_same_sql("subquery_correlated", """SELECT o.o_orderkey, o.o_totalprice FROM orders o
WHERE o.o_totalprice > (SELECT 1.2 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) """, "orders")
_same_sql("cte", """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
 rich AS (SELECT * FROM spent WHERE total > 3000000)
SELECT n_name, count(*) AS customers, round(sum(total), 2) AS total FROM rich
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name """,
          "orders", "customer", "nation")


@query("pivot", """
SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F,
  round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O,
  round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1""")
def pivot(spark, sf):
    return (table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"])
            .agg(F.round(F.sum("o_totalprice"), 2)))


@query("unpivot", """
SELECT l_orderkey, l_linenumber, measure, amount FROM
 (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))""")
def unpivot(spark, sf):
    return (table(spark, sf, "lineitem")
            .unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount"))


@query("star_except_replace", """
SELECT * EXCLUDE (c_name) REPLACE (round(c_acctbal, 0) AS c_acctbal) RENAME (c_mktsegment AS segment) FROM customer""")
def star_except_replace(spark, sf):
    return (table(spark, sf, "customer").drop("c_name").withColumn("c_acctbal", F.round("c_acctbal", 0))
            .withColumnsRenamed({"c_mktsegment": "segment"}))


@query("sample", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
WHERE substr(md5(concat('42|', o_orderkey)), 1, 8) < '19999999'""")
def sample(spark, sf):
    return sample_rows(table(spark, sf, "orders"), ["o_orderkey"], 0.1, seed=42).drop("o_orderdate")


# ---- scalar functions

@query("fn_string", """
SELECT doc_id, length(text) AS n, md5(lower(text)) AS low, upper(lang) AS up, md5(trim(text)) AS bare, len(string_split(text, ' ')) AS words,
  substr(text, 3, 12) AS part, strpos(text, 'the') AS first_the, md5(replace(text, ' ', '')) AS solid,
  md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked, regexp_extract(text, '([0-9]+)', 1) AS digits,
  lpad(source, 8, '*') AS padded, concat(lang, nullif(lang, 'en'), '-', source) AS joined, starts_with(source, 'src1') AS one
FROM documents""")
def fn_string(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.length("text").cast("bigint").alias("n"), F.md5(F.lower("text")).alias("low"), F.upper("lang").alias("up"), F.md5(F.trim("text")).alias("bare"),
        F.size(F.split("text", " ")).cast("bigint").alias("words"), F.substring("text", 3, 12).alias("part"),
        F.instr("text", "the").cast("bigint").alias("first_the"), F.md5(F.replace("text", F.lit(" "), F.lit(""))).alias("solid"),
        F.md5(F.regexp_replace("text", "[0-9]+", "#")).alias("masked"), F.regexp_extract("text", "([0-9]+)", 1).alias("digits"),
        F.lpad("source", 8, "*").alias("padded"),
        F.concat_ws("", "lang", F.expr("nullif(lang, 'en')"), F.lit("-"), "source").alias("joined"),
        F.startswith("source", F.lit("src1")).alias("one"))


@query("fn_date", """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, extract(year FROM o_orderdate) AS y,
  quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS dow, dayofyear(o_orderdate) AS doy, week(o_orderdate) AS wk,
  date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days,
  strftime(o_orderdate + INTERVAL 40 DAY, '%d/%m/%Y') AS later, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
  CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders""")
def fn_date(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(F.date_trunc("month", day), "yyyy-MM-dd").alias("month"),
        F.year(day).cast("bigint").alias("y"), F.quarter(day).cast("bigint").alias("q"),
        F.dayofweek(day).cast("bigint").alias("dow"), F.dayofyear(day).cast("bigint").alias("doy"),
        F.weekofyear(day).cast("bigint").alias("wk"),
        F.datediff(F.lit("2002-01-01").cast("date"), day).cast("bigint").alias("days"),
        F.date_format(day + F.expr("INTERVAL 40 DAY"), "dd/MM/yyyy").alias("later"),
        F.date_format(F.last_day(day), "yyyy-MM-dd").alias("month_end"),
        F.unix_seconds(day.cast("timestamp")).alias("seconds"))


@query("fn_date_sequence", """
SELECT event_type, strftime(day, '%Y-%m-%d') AS day FROM (SELECT event_type,
  unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS day FROM events GROUP BY 1)""")
def fn_date_sequence(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).select(
        "event_type", F.explode(F.sequence("a", "b")).alias("day")).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd"))


_same_sql("fn_math", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_discount, 4) AS saved, CAST(floor(l_extendedprice / 7) AS BIGINT) AS f,
 CAST(ceil(l_quantity / 3) AS BIGINT) AS c, abs(l_quantity - 25) AS a, round(sqrt(l_extendedprice), 6) AS s, round(ln(l_quantity + 1), 6) AS l,
 round(power(l_discount, 2), 8) AS p, l_partkey % 7 AS m, greatest(l_discount, l_tax) AS g, CAST(sign(l_quantity - 25) AS INTEGER) AS sg,
 round(exp(l_tax), 6) AS e FROM lineitem """, "lineitem")


@query("fn_array", """
SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS head, CAST(embedding[-1] AS DOUBLE) AS tail,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, CAST(list_max(embedding) AS DOUBLE) AS top,
  len(list_filter(embedding, lambda x: x > 0)) AS positive, CAST(list_sort(embedding)[2] AS DOUBLE) AS second_low,
  list_contains(embedding, 0) AS has_zero FROM embeddings""")
def fn_array(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size(e).cast("bigint").alias("n"), F.element_at(e, 1).cast("double").alias("head"),
        F.element_at(e, -1).cast("double").alias("tail"),
        F.round(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6).alias("total"),
        F.array_max(e).cast("double").alias("top"), F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positive"),
        F.array_sort(e)[1].cast("double").alias("second_low"), F.array_contains(e, F.lit(0).cast("float")).alias("has_zero"))


@query("fn_explode", """
SELECT label, i AS position, count(*) AS n, count(*) FILTER (WHERE x > 0) AS positive FROM
 (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2""")
def fn_explode(spark, sf):
    return (table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("position", "x"))
            .groupBy("label", "position").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") > 0).alias("positive")))


@query("fn_map", """
SELECT conv_id, string_agg(role, ',' ORDER BY role) AS roles, sum(CASE role WHEN 'user' THEN n END)::BIGINT AS from_user,
  sum(n)::BIGINT AS turns FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def fn_map(spark, sf):
    """One map per conversation, from role to number of turns; there are only a few roles."""
    counted = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    maps = counted.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return maps.select("conv_id", F.concat_ws(",", F.array_sort(F.map_keys("m"))).alias("roles"),
                       F.try_element_at("m", F.lit("user")).alias("from_user"),
                       F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("turns"))


@query("fn_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text,
  json_extract_string(props, '$.missing') AS missing FROM events""")
def fn_json(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text"),
        F.try_variant_get(F.parse_json("props"), "$.missing", "string").alias("missing"))


@query("fn_struct", """
SELECT event_id, s.who AS who, s.what.kind AS kind FROM
 (SELECT event_id, {'who': user_id, 'what': {'kind': event_type, 'size': value}} AS s FROM events)""")
def fn_struct(spark, sf):
    s = F.struct(F.col("user_id").alias("who"), F.struct(F.col("event_type").alias("kind"), F.col("value").alias("size")).alias("what"))
    return table(spark, sf, "events").select("event_id", s.alias("s")).select(
        "event_id", F.col("s.who").alias("who"), F.col("s.what.kind").alias("kind"))
