import pytest
from pyspark.sql import functions as F

import samples
from steplake.operators.profile import display_type, histogram, profile, sampled_profile, suggest_rules
from steplake.operators.quality import (Rule, breach_trend, evaluate, flag_rows, health_score,
                                        quality_overview, quarantine, sample_violations, table_report,
                                        write_quarantine)


@pytest.fixture()
def loans(spark):
    return samples.loans(spark)


def results(df, *rules):
    return {r.rule_id: r for r in evaluate(df, list(rules), "t").collect()}


def test_rules_that_pass(loans):
    report = evaluate(loans, [Rule("1", "not_null", "loan"), Rule("2", "unique", "loan"), Rule("3", "range", "fee", {"min": 0})], "loans")
    assert {r.status for r in report.collect()} == {"passed"}
    assert health_score(report) == 100.0
    assert table_report(report).first().total_rules == 3


def test_every_rule_type(loans):
    out = results(
        loans, Rule("nn", "not_null", "due"), Rule("u", "unique", "card"),
        Rule("r", "range", "fee", {"min": 1, "max": 30}), Rule("r0", "range", "fee"),
        Rule("a", "allowed_values", "state", {"values": ["back"]}), Rule("a0", "allowed_values", "renewals"),
        Rule("n", "row_count_min", None, {"min_count": 20}), Rule("x", "regex", "card", {"pattern": "0[1-5]$"}),
        Rule("c", "custom_sql", None, {"sql": "renewals >= 1"}), Rule("bad", "custom_sql", None, {"sql": "nope > 1"}),
        Rule("worse", "custom_sql", None, {"sql": "SELECT FROM"}), Rule("gone", "not_null", "nope"))
    failed = {k: v.failed_rows for k, v in out.items()}
    assert failed["nn"] == 2 and failed["u"] == 2 and failed["r"] == 6 and failed["r0"] == 0 and failed["a"] == 5 and failed["a0"] == 14
    assert failed["n"] == 5 and out["n"].failure_rate == 1.0
    assert out["nn"].failure_rate == 0.1333 and failed["x"] == 8
    assert failed["c"] == loans.filter("renewals < 1").count()  # NULL is no violation
    for name in ("bad", "worse", "gone"):
        assert (out[name].status, out[name].passed) == ("error", False)


def test_rules_may_share_an_id(loans):
    rows = evaluate(loans, [Rule("same", "not_null", "due"), Rule("same", "not_null", "nope"), Rule("same", "unique", "loan")]).collect()
    assert [(r.rule_id, r.status) for r in rows] == [("same", "failed"), ("same", "error"), ("same", "passed")]


def test_empty_inputs(spark, loans):
    out = results(loans.limit(0), Rule("nn", "not_null", "loan"), Rule("n", "row_count_min"))
    assert out["nn"].passed and out["nn"].failure_rate == 0.0 and not out["n"].passed
    nothing = evaluate(loans, [], "t")
    assert nothing.count() == 0 and health_score(nothing) == 100.0


def test_rule_checks():
    with pytest.raises(ValueError, match="unknown rule type"):
        Rule("x", "nope")
    with pytest.raises(ValueError, match="needs a column"):
        Rule("x", "not_null")
    with pytest.raises(ValueError, match="severity"):
        Rule("x", "not_null", "id", severity="fatal")


def test_overview(loans):
    a = evaluate(loans, [Rule("1", "not_null", "due"), Rule("2", "not_null", "loan")], "a")
    b = evaluate(loans, [Rule("3", "not_null", "loan")], "b")
    scores = {r.table_name: r.health_score for r in quality_overview([a, b]).collect()}
    assert scores == {"a": 50.0, "b": 100.0, None: 66.7}


def test_samples(loans):
    assert sorted(r.loan for r in sample_violations(loans, Rule("x", "not_null", "due")).collect()) == [3, 9]
    assert sorted(tuple(r) for r in sample_violations(loans, Rule("x", "unique", "card")).collect()) == [("C-02", 2), ("C-04", 2)]
    assert sample_violations(loans, Rule("x", "range", "loan", {"min": 100}), 3, ["loan"]).count() == 3


def test_flags_and_quarantine(loans, folder):
    rules = [Rule("u", "unique", "card"), Rule("d", "not_null", "due"), Rule("n", "row_count_min")]
    flags = {r.loan: r.broken_rules for r in flag_rows(loans, rules).collect()}
    assert flags[2] == flags[6] == flags[4] == ["u"] and flags[3] == ["d"] and flags[1] == []
    good, bad = quarantine(loans, rules)
    assert (good.count(), bad.count()) == (9, 6)
    write_quarantine(loans, rules, f"{folder}/q")
    back = loans.sparkSession.read.parquet(f"{folder}/q")
    assert back.groupBy("is_bad").count().orderBy("is_bad").collect()[1]["count"] == 6


def test_flags_with_a_hot_value_and_nulls(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") < 1000, "hot").when(F.col("id") < 2000, F.lit(None)).when(F.col("id") < 2500, F.col("id").cast("string"))
        .otherwise((F.col("id") % 250).cast("string")).alias("v"))
    flagged = flag_rows(df, [Rule("u", "unique", "v"), Rule("u2", "unique", "id")])
    assert flagged.count() == 3000
    wrong = flagged.filter((F.size("broken_rules") > 0) != (
        (F.col("id") < 1000) | (F.col("id") >= 2500)))
    assert wrong.count() == 0


def test_trend(spark):
    history = spark.createDataFrame([("a", "2025-06-10 01:00:00", 3), ("a", "2025-06-10 02:00:00", 4),
                                     ("b", "2025-01-01 00:00:00", 9)], "rule_id string, evaluated_at string, failed_rows bigint"
                                    ).withColumn("evaluated_at", F.to_timestamp("evaluated_at"))
    trend = breach_trend(history, "2025-06-12", 5).orderBy("rule_id", "day").collect()
    assert [(r.rule_id, r.failed_rows) for r in trend] == [
        ("a", 0), ("a", 0), ("a", 7), ("a", 0), ("a", 0)] + [("b", 0)] * 5


def test_profile(loans):
    rows = {r["name"]: r for r in profile(loans).collect()}
    assert rows["due"].null_count == 2 and rows["due"].null_pct == 13.3
    assert rows["card"].distinct_count == 13 and rows["loan"].max_value == "15"
    assert [rows[c].display_type for c in ("loan", "fee", "branch", "due")] == ["int", "dec", "txt", "date"]
    assert len(rows["loan"].histogram) == 8 and max(rows["loan"].histogram) == 1.0 and rows["branch"].histogram is None
    approx = {r["name"]: r.distinct_count for r in profile(loans, approx=True).collect()}
    assert approx["state"] == 3
    rules = {(r.rule_type, r.column_name) for r in suggest_rules(profile(loans), "t").collect()}
    assert ("not_null", "due") in rules and ("unique", "loan") in rules and ("unique", "card") not in rules


def test_profile_of_empty_and_odd_columns(spark, loans):
    assert {r.null_pct for r in profile(loans.limit(0)).collect()} == {0.0}
    odd = spark.sql("SELECT map('a', 1) AS m, parse_json('{}') AS v, array(1) AS l, INTERVAL '1' DAY AS `i.x`, true AS b")
    rows = {r["name"]: r for r in profile(odd).collect()}
    assert rows["i.x"].display_type == "txt" and rows["m"].display_type == "json" and rows["b"].display_type == "bool"
    assert [display_type(f.dataType) for f in samples.meters(spark).schema][-1] == "ts"


def test_histogram(spark):
    df = spark.range(0, 81).select("id", F.lit(5).alias("same"), F.lit(None).cast("int").alias("none"))
    bars = histogram(df, ["id", "same", "none"]).orderBy("column", "bin").collect()
    assert [b["count"] for b in bars if b["column"] == "id"] == [10] * 7 + [11]
    assert [b["count"] for b in bars if b["column"] == "same"] == [81] + [0] * 7
    assert not [b for b in bars if b["column"] == "none"]


def test_histogram_counts_odd_values_apart(spark):
    df = spark.range(0, 81).select(F.col("id").cast("double").alias("x")).unionAll(
        spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double"))
    bars = {b["bin"]: b["count"] for b in histogram(df, "x").collect()}
    assert bars == {0: 3} | {i: 10 for i in range(1, 8)} | {8: 11}
    only = histogram(df.filter("isnan(x)"), "x").collect()
    assert [(b["bin"], b["count"], b["low"]) for b in only] == [(0, 1, None)]
    assert max(profile(df).first().histogram) == 1.0


def test_sampled_profile(loans):
    row = sampled_profile(loans, 0.5).first()
    assert row.table_rows == 15 and row.sample_rows <= 15
    assert sampled_profile(loans, 1.0, keys=["loan"]).first().sample_rows == 15


def test_rules_that_share_an_id_all_count(spark):
    rows = spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a int, b int")
    rules = [Rule("r", "not_null", "a"), Rule("r", "not_null", "b")]
    good, bad = quarantine(rows, rules)
    assert [tuple(r) for r in good.collect()] == [(3, 3)] and sorted(r.broken_rules for r in bad.collect()) == [["r"], ["r"]]


def test_long_values_are_flagged_like_short_ones(spark):
    long = "x" * 5000
    rows = spark.createDataFrame([(long,)] * 400 + [(long + "y",)] + [(f"v{i % 300}",) for i in range(400)] + [(None,)], "t string")
    flagged = flag_rows(rows, [Rule("u", "unique", "t")])
    got = {r.t: r.broken_rules for r in flagged.distinct().collect()}
    assert got[long] == ["u"] and got[long + "y"] == [] and got["v5"] == ["u"] and got["v200"] == [] and got[None] == []
    assert flagged.count() == rows.count()


def test_several_unique_rules_do_not_repeat_rows(spark):
    rows = spark.createDataFrame([(i % 7, f"t{i % 40}" if i % 3 else None, i) for i in range(90)], "a int, b string, c int")
    rules = [Rule("1", "unique", "a"), Rule("2", "unique", "b"), Rule("3", "unique", "c"), Rule("4", "unique", "a"), Rule("5", "not_null", "b"), Rule("6", "unique", "none")]
    report = evaluate(rows, rules)
    got = {r.rule_id: (r.failed_rows, r.status) for r in report.collect()}
    filled = [r.b for r in rows.collect() if r.b is not None]
    assert got == {"1": (83, "failed"), "2": (len(filled) - len(set(filled)), "failed"), "3": (0, "passed"), "4": (83, "failed"), "5": (30, "failed"), "6": (0, "error")}
    assert "Expand" not in report._jdf.queryExecution().executedPlan().toString()
    assert {r.rule_id: r.failed_rows for r in evaluate(rows.limit(0), rules).collect()} == dict.fromkeys("123456", 0)
