"""Table functions and aggregates of Python, called from SQL."""

from steplake.conformance.registry import query, table
from steplake.functions.sql import run_sql
from steplake.functions.sql_functions import register


def _run(spark, sf, text, *names):
    register(spark)
    return run_sql(spark, text, None, **{n: table(spark, sf, n) for n in names})


@query("udtf_sessions", """
WITH gaps AS (SELECT event_id, user_id, ts, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CAST(sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 86400000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps""")
def udtf_sessions(spark, sf):
    return _run(spark, sf, """SELECT event_id, user_id, session FROM sessions(
      TABLE(SELECT event_id, user_id, ts FROM {events}) PARTITION BY user_id ORDER BY (ts, event_id), 'ts', 86400)""", "events")


@query("udtf_first_rows", """
SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS place FROM orders) WHERE place <= 2""")
def udtf_first_rows(spark, sf):
    return _run(spark, sf, """SELECT o_custkey, o_orderkey, place FROM first_rows(
      TABLE(SELECT o_custkey, o_orderkey FROM {orders}) PARTITION BY o_custkey ORDER BY (o_orderkey DESC), 2)""", "orders")


@query("udtf_melted", """
SELECT s_suppkey, 's_name' AS name, s_name AS value FROM supplier WHERE s_name IS NOT NULL
UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_nationkey <> 3""")
def udtf_melted(spark, sf):
    return _run(spark, sf, """SELECT * FROM melted(
      TABLE(SELECT s_suppkey, s_name, nullif(s_nationkey, 3) AS s_nationkey FROM {supplier}), 's_suppkey')""", "supplier")


@query("udaf_weighted_median", """
SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS middle FROM lineitem GROUP BY 1""")
def udaf_weighted_median(spark, sf):
    return _run(spark, sf, """SELECT l_returnflag, weighted_median(v, n) AS middle FROM
      (SELECT l_returnflag, l_extendedprice AS v, count(*) AS n FROM {lineitem} GROUP BY ALL) GROUP BY l_returnflag""", "lineitem")


@query("udaf_most_frequent", """
SELECT user_id, event_type AS usual FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def udaf_most_frequent(spark, sf):
    return _run(spark, sf, """SELECT user_id, most_frequent(event_type, n) AS usual FROM
      (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY ALL) GROUP BY user_id""", "events")
