"""Profiles and quality rules on the driver tables."""

from pyspark.sql import functions as F

from steplake.conformance.registry import query, table
from steplake.operators import partitioned
from steplake.operators.profile import histogram, profile, sampled_profile, suggest_rules
from steplake.operators.quality import (Rule, breach_trend, evaluate, flag_rows, quality_overview, quarantine,
                                        sample_violations, table_report)
from steplake.operators.quality_state import add_load, breach_history, whole_results
from steplake.operators.sketches import read_sketches, refresh_sketches, sketch, sketched_profile
from steplake.session import scratch_path

_NULLED = """SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice,
  o_orderpriority, o_custkey % 2 = 0 AS even_customer FROM {orders}"""


def _nulled(spark, sf):
    return spark.sql(_NULLED, orders=table(spark, sf, "orders"))


def _profile_sql(position, column, data_type, chip, source):
    text = f"CAST({{f}}({column}) AS VARCHAR)" if chip != "dec" else "CAST({f}(%s) AS VARCHAR)" % column
    return f"""SELECT {position} AS position, '{column}' AS name, '{data_type}' AS data_type, '{chip}' AS display_type,
  count(*) AS total_rows, count(*) - count({column}) AS null_count,
  CAST(round((count(*) - count({column})) * 100.0 / count(*), 1) AS DOUBLE) AS null_pct,
  count(DISTINCT {column}) AS distinct_count, {text.format(f='min')} AS min_value, {text.format(f='max')} AS max_value
  FROM ({source})"""


_PROFILE_COLUMNS = [("o_orderkey", "bigint", "int"), ("o_custkey", "bigint", "int"),
                    ("o_orderstatus", "string", "txt"), ("o_totalprice", "double", "dec"),
                    ("o_orderpriority", "string", "txt"), ("even_customer", "boolean", "bool")]


@query("profile_orders", "\nUNION ALL ".join(
    _profile_sql(i, *c, _NULLED.format(orders="orders")) for i, c in enumerate(_PROFILE_COLUMNS)))
def profile_orders(spark, sf):
    return profile(_nulled(spark, sf)).drop("histogram")


def _bars_sql(column, source, bins=8):
    return f"""SELECT '{column}' AS "column", CAST(bin AS INTEGER) AS bin,
  count({column}) AS "count", round(count({column}) / max(count({column})) OVER (), 6) AS height
FROM range(1, {bins + 1}) b(bin) LEFT JOIN
  (SELECT {column}, least(floor(({column} - lo) / ((hi - lo) / {bins})) + 1, {bins}) AS place
   FROM {source}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {source})) ON place = bin
GROUP BY bin"""


@query("histogram_totalprice", f"{_bars_sql('o_totalprice', 'orders')} UNION ALL {_bars_sql('o_orderkey', 'orders')}")
def histogram_totalprice(spark, sf):
    bars = histogram(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])
    return bars.select("column", "bin", "count", F.round("height", 6).alias("height"))


@query("profile_histogram", f"""
SELECT name, string_agg(printf('%.6f', height), ',' ORDER BY bin) AS bars
FROM (SELECT "column" AS name, bin, height FROM ({_bars_sql('o_totalprice', 'orders')})) GROUP BY name""")
def profile_histogram(spark, sf):
    out = profile(table(spark, sf, "orders").select("o_totalprice"))
    bars = F.transform("histogram", lambda h: F.format_string("%.6f", h))
    return out.select("name", F.concat_ws(",", bars).alias("bars"))


@query("suggest_rules", """
WITH p AS (SELECT 'o_orderkey' AS name, count(*) AS n, count(o_orderkey) AS filled, count(DISTINCT o_orderkey) AS d FROM orders
  UNION ALL SELECT 'o_custkey', count(*), count(o_custkey), count(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', count(*), count(nullif(o_orderstatus, 'P')), count(DISTINCT nullif(o_orderstatus, 'P')) FROM orders)
SELECT concat('rule-orders-not_null-', name) AS id, 'orders' AS table_name, 'not_null' AS rule_type, name AS column_name
FROM p WHERE filled < n
UNION ALL SELECT concat('rule-orders-unique-', name), 'orders', 'unique', name FROM p WHERE filled > 0 AND d = filled""")
def suggested(spark, sf):
    profiled = profile(_nulled(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus"), bins=0)
    return suggest_rules(profiled, "orders").drop("reason")


_SAMPLED = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
  WHERE substr(md5(concat('42|', o_orderkey)), 1, 8) < '33333333'"""


@query("sampled_profile", f"""SELECT * EXCLUDE (total_rows), total_rows AS sample_rows, (SELECT count(*) FROM orders) AS table_rows
FROM ({" UNION ALL ".join(_profile_sql(i, *c, _SAMPLED) for i, c in enumerate(_PROFILE_COLUMNS[:5]))})""")
def profile_of_sample(spark, sf):
    sampled = sampled_profile(table(spark, sf, "orders").drop("o_orderdate"), 0.2, keys=["o_orderkey"], bins=0)
    return sampled.drop("histogram")


ORDER_RULES = [
    Rule("o1", "not_null", "o_orderstatus"),
    Rule("o2", "unique", "o_orderkey"),
    Rule("o3", "unique", "o_custkey", severity="warn"),
    Rule("o4", "allowed_values", "o_orderstatus", {"values": ["F"]}, severity="warn"),
    Rule("o5", "regex", "o_orderpriority", {"pattern": "^[1-4]-"}),
    Rule("o6", "custom_sql", None, {"sql": "o_totalprice < 400000 OR o_orderstatus = 'F'"}),
    Rule("o7", "row_count_min", None, {"min_count": 1000000000}),
    Rule("o8", "allowed_values", "o_orderstatus", {"values": []}),
    Rule("o9", "range", "no_such_column", {"min": 0}),
]
CUSTOMER_RULES = [Rule("c1", "range", "c_acctbal", {"min": 0}), Rule("c2", "range", "c_acctbal", {"max": 99999}),
                  Rule("c3", "range", "c_nationkey", {"min": 3, "max": 20}, severity="warn"),
                  Rule("c4", "range", "c_nationkey")]
LINE_RULES = [Rule("l1", "unique", "l_orderkey"), Rule("l2", "not_null", "l_shipdate"),
              Rule("l3", "allowed_values", "l_linenumber", {"values": [1, 2, 3, 4, 5]}),
              Rule("l4", "row_count_min", None, {"min_count": 10})]

# what the SQL twin counts for each rule: rows that break it
_FAILS = {
    "o1": "count(*) - count(o_orderstatus)",
    "o2": "count(o_orderkey) - count(DISTINCT o_orderkey)",
    "o3": "count(o_custkey) - count(DISTINCT o_custkey)",
    "o4": "count(*) FILTER (WHERE o_orderstatus NOT IN ('F'))",
    "o5": "count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-'))",
    "o6": "count(*) FILTER (WHERE NOT (o_totalprice < 400000 OR o_orderstatus = 'F'))",
    "o7": "1000000000 - count(*)",
    "o8": "count(o_orderstatus)",
    "o9": None,
    "c1": "count(*) FILTER (WHERE c_acctbal < 0)",
    "c2": "count(*) FILTER (WHERE c_acctbal > 99999)",
    "c3": "count(*) FILTER (WHERE c_nationkey < 3 OR c_nationkey > 20)",
    "c4": "0",
    "l1": "count(l_orderkey) - count(DISTINCT l_orderkey)",
    "l2": "count(*) - count(l_shipdate)",
    "l3": "count(*) FILTER (WHERE l_linenumber NOT IN (1, 2, 3, 4, 5))",
    "l4": "0",
}


def _rule_sql(rule, name, source):
    failed = _FAILS[rule.id] or "0"
    wrong = _FAILS[rule.id] is None
    column = f"'{rule.column_name}'" if rule.column_name else "CAST(NULL AS VARCHAR)"
    rate = "1.0::DOUBLE" if wrong else (
        "CASE WHEN failed = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END" if rule.rule_type == "row_count_min"
        else "round(failed / total, 4)")
    return f"""SELECT '{rule.id}' AS rule_id, '{name}' AS table_name, {column} AS column_name,
  '{rule.rule_type}' AS rule_type, {'false' if wrong else 'failed = 0'} AS passed, total AS total_rows,
  failed AS failed_rows, {rate} AS failure_rate, '{rule.severity}' AS severity,
  {"'error'" if wrong else "CASE WHEN failed = 0 THEN 'passed' ELSE 'failed' END"} AS status
  FROM (SELECT count(*) AS total, CAST({failed} AS BIGINT) AS failed FROM {source})"""


_NULLED_ORDERS = f"({_NULLED.format(orders='orders')})"
_ORDERS_SQL = "\nUNION ALL ".join(_rule_sql(r, "orders", _NULLED_ORDERS) for r in ORDER_RULES)
_ALL_SQL = "\nUNION ALL ".join([_ORDERS_SQL, *[_rule_sql(r, "customer", "customer") for r in CUSTOMER_RULES],
                               *[_rule_sql(r, "lineitem", "lineitem") for r in LINE_RULES]])
_REPORT = """count(*) AS total_rules, count(*) FILTER (WHERE passed) AS passed_rules,
  count(*) FILTER (WHERE NOT passed) AS failed_rules,
  CAST(round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 1) AS DOUBLE) AS health_score"""


@query("quality_report", _ORDERS_SQL)
def quality_report(spark, sf):
    return evaluate(_nulled(spark, sf), ORDER_RULES, "orders").drop("message")


@query("quality_table_report", f"SELECT table_name, {_REPORT} FROM ({_ORDERS_SQL}) GROUP BY table_name")
def quality_table_report(spark, sf):
    return table_report(evaluate(_nulled(spark, sf), ORDER_RULES, "orders"))


@query("quality_overview", f"SELECT table_name, {_REPORT} FROM ({_ALL_SQL}) GROUP BY ROLLUP (table_name)")
def overview(spark, sf):
    return quality_overview([evaluate(_nulled(spark, sf), ORDER_RULES, "orders"),
                             evaluate(table(spark, sf, "customer"), CUSTOMER_RULES, "customer"),
                             evaluate(table(spark, sf, "lineitem"), LINE_RULES, "lineitem")])


@query("quality_samples", "SELECT * FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 10")
def quality_samples(spark, sf):
    return sample_violations(table(spark, sf, "customer"), CUSTOMER_RULES[0], 10, ["c_custkey"])


@query("quality_samples_unique", """
SELECT l_orderkey, count(*) AS jml_duplikat FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
ORDER BY l_orderkey LIMIT 10""")
def quality_samples_unique(spark, sf):
    return sample_violations(table(spark, sf, "lineitem"), LINE_RULES[0], 10)


_FLAG_RULES = [ORDER_RULES[i] for i in (0, 2, 4, 5)]
_FLAGS_SQL = f"""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus IS NULL THEN 'o1' END,
  CASE WHEN count(o_custkey) OVER (PARTITION BY o_custkey) > 1 THEN 'o3' END,
  CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'o5' END,
  CASE WHEN NOT (o_totalprice < 400000 OR o_orderstatus = 'F') THEN 'o6' END) AS broken FROM {_NULLED_ORDERS}"""


def _joined(df):
    return df.select("o_orderkey", F.concat_ws(",", "broken_rules").alias("broken"))


@query("flag_rows", _FLAGS_SQL)
def flagged(spark, sf):
    return _joined(flag_rows(_nulled(spark, sf), _FLAG_RULES))


@query("flag_rows_repeated", """
SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (WHERE same > 1) AS n_flagged
FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_returnflag) AS same FROM lineitem)
GROUP BY ALL""")
def flagged_repeated(spark, sf):
    """Three values share all rows: each of them is a hot key."""
    out = flag_rows(table(spark, sf, "lineitem"), [Rule("u", "unique", "l_returnflag")])
    return out.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("broken_rules") > 0).alias("n_flagged"))


@query("quarantine", f"""
SELECT o_orderstatus IS NOT NULL AND regexp_matches(o_orderpriority, '^[1-4]-')
       AND (o_totalprice < 400000 OR o_orderstatus = 'F') AS good,
  count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM {_NULLED_ORDERS} GROUP BY 1""")
def quarantined(spark, sf):
    good, bad = quarantine(_nulled(spark, sf), [ORDER_RULES[i] for i in (0, 1, 4, 5)])
    both = good.select("o_orderkey", F.lit(True).alias("good")).unionByName(
        bad.select("o_orderkey", F.lit(False).alias("good")))
    return both.groupBy("good").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("quality_trend", """
WITH history AS (SELECT event_type AS rule_id, CAST(ts AS DATE) AS day, user_id % 5 AS failed_rows FROM events),
last AS (SELECT max(day) AS d FROM history),
wanted AS (SELECT rule_id, CAST(d - CAST(i AS INTEGER) AS DATE) AS day
           FROM (SELECT DISTINCT rule_id FROM history), last, range(14) r(i))
SELECT w.rule_id, strftime(w.day, '%Y-%m-%d') AS day, CAST(coalesce(sum(failed_rows), 0) AS BIGINT) AS failed_rows
FROM wanted w LEFT JOIN history h USING (rule_id, day) GROUP BY 1, 2""")
def trend(spark, sf):
    events = table(spark, sf, "events")
    history = events.selectExpr("event_type AS rule_id", "ts AS evaluated_at", "user_id % 5 AS failed_rows")
    out = breach_trend(history, events.agg(F.max("ts")).scalar())
    return out.select("rule_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "failed_rows")


_SKETCHED_SQL = """SELECT {position} AS position, '{column}' AS name, count(*) AS total_rows, count(*) - count({value}) AS null_count,
  count(DISTINCT {value}) AS distinct_count, CAST(min({value}) AS VARCHAR) AS min_value, CAST(max({value}) AS VARCHAR) AS max_value FROM ({source})"""
# the first priority was loaded twice
_LOADED = """SELECT nullif(o_orderstatus, 'P') AS status, month(o_orderdate) AS month, o_orderpriority FROM orders
UNION ALL SELECT nullif(o_orderstatus, 'P'), month(o_orderdate), o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'"""


@query("profile_sketched", "\nUNION ALL ".join(
    _SKETCHED_SQL.format(position=i, column=c, value=c, source=_LOADED) + " WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"
    for i, c in enumerate(["status", "month"])))
def profile_sketched(spark, sf):
    """Sketches kept beside a partitioned table are refreshed after a load, which reads the loaded partition alone; two
    partitions' sketches merge into their profile. Few values are counted exactly by a sketch."""
    path, kept = scratch_path(spark, "profiled"), scratch_path(spark, "sketches")
    rows = table(spark, sf, "orders").selectExpr("nullif(o_orderstatus, 'P') AS status", "month(o_orderdate) AS month", "o_orderpriority")
    partitioned.append(rows, path, ["o_orderpriority"])
    first = refresh_sketches(spark.read.parquet(path), kept, ["o_orderpriority"])
    partitioned.append(rows.filter("o_orderpriority = '1-URGENT'"), path, ["o_orderpriority"])
    again = refresh_sketches(spark.read.parquet(path), kept, ["o_orderpriority"])
    if again != 1 or refresh_sketches(spark.read.parquet(path), kept, ["o_orderpriority"]) != 0 or first < again:
        raise RuntimeError("partitions without new files were read again")
    chosen = read_sketches(spark, kept).filter("o_orderpriority IN ('1-URGENT', '5-LOW')")
    return sketched_profile(chosen).select("position", "name", "total_rows", "null_count", "distinct_count", "min_value", "max_value")


@query("profile_sketch_ranks", """
SELECT 'l_extendedprice' AS name, count(*) AS total_rows, true AS q25_near, true AS q50_near, true AS q75_near, true AS count_near FROM lineitem""")
def profile_sketch_ranks(spark, sf):
    """Quartiles and the distinct count of merged sketches, by how far they lie from the exact ones."""
    lines = table(spark, sf, "lineitem").select("l_extendedprice", "l_returnflag")
    found = sketched_profile(sketch(lines, ["l_returnflag"])).filter("name = 'l_extendedprice'").first()
    price = F.col("l_extendedprice")
    return lines.agg(
        F.lit(found["name"]).alias("name"), F.count(F.lit(1)).alias("total_rows"),
        *[(F.abs(F.count_if(price <= found[q]) / F.count(price) - share) < 0.02).alias(f"{q}_near") for q, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))],
        (F.abs(found["distinct_count"] / F.count_distinct(price) - 1) < 0.04).alias("count_near"))


_LOADED_RULES = [Rule("r1", "not_null", "status"), Rule("r2", "unique", "o_custkey"), Rule("r3", "range", "o_totalprice", {"min": 5000}),
                 Rule("r4", "unique", "o_orderkey"), Rule("r5", "row_count_min", params={"min_count": 10**12}), Rule("r6", "regex", "status", {"pattern": "^[FO]$"})]
_LOADED_RULES_SQL = """SELECT {id} AS rule_id, count(*) AS total_rows, CAST({failed} AS BIGINT) AS failed_rows
  FROM (SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders) {where}"""


def _loaded_rules_sql(where=""):
    failed = {"r1": "count(*) - count(status)", "r2": "count(o_custkey) - count(DISTINCT o_custkey)", "r3": "count(*) FILTER (WHERE o_totalprice < 5000)",
              "r4": "0", "r5": "1000000000000 - count(*)", "r6": "0"}
    return "\nUNION ALL ".join(_LOADED_RULES_SQL.format(id=f"'{i}'", failed=f, where=where) for i, f in failed.items())


def _judged_loads(spark, sf):
    """Three loads, the second one judged twice."""
    path = scratch_path(spark, "loads")
    orders = table(spark, sf, "orders").withColumn("status", F.expr("nullif(o_orderstatus, 'P')"))
    for load in (0, 1, 1, 2):
        add_load(orders.filter(F.col("o_orderkey") % 3 == load), _LOADED_RULES, path, load)
    return path


@query("quality_whole_table", _loaded_rules_sql())
def quality_whole_table(spark, sf):
    """What three loads have left adds up to the results for all rows, the unique rules included."""
    return whole_results(spark, _LOADED_RULES, _judged_loads(spark, sf)).select("rule_id", "total_rows", "failed_rows")


@query("quality_load_history", "\nUNION ALL ".join(
    f"SELECT *, '{load}' AS load FROM ({_loaded_rules_sql(f'WHERE o_orderkey % 3 = {load}')})" for load in range(3)))
def quality_load_history(spark, sf):
    return breach_history(spark, _LOADED_RULES, _judged_loads(spark, sf))
