from datetime import date

import pytest
from pyspark.sql import functions as F

import samples
from steplake.functions.casts import resolve_type
from steplake.operators import steps as S
from steplake.operators.edits import batch_edit
from steplake.plans.step_list import Step, clean_events_steps, run_observed, run_steps, step_row_counts

# loans that came back, one per card
RETURNED = [Step("filter", {"column": "state", "value": "back"}, "returned"), Step("drop_null", {"column": "due"}, "with a date"),
            Step("deduplicate", {"columns": ["card"], "order_by": ["loan"]}, "one per card"),
            Step("limit", {"n": 1}, "off", enabled=False)]


def ids(df):
    return sorted(r.loan for r in df.collect())


@pytest.fixture()
def loans(spark):
    return samples.loans(spark)


def test_step_list(loans):
    result = run_steps(loans, RETURNED)
    assert ids(result) == [1, 2, 7, 11, 12, 13, 14]
    counts = [(r.kind, r.rows_in, r.rows_out) for r in step_row_counts(loans, RETURNED).orderBy("step").collect()]
    assert counts == [("filter", 15, 10), ("drop_null", 10, 8), ("deduplicate", 8, 7)]


def test_observed_counts(loans, folder):
    seen = run_observed(loans, RETURNED, f"{folder}/out")
    assert [(s["rows_in"], s["rows_out"]) for s in seen] == [(15, 10), (10, 8), (8, 7)]
    assert loans.sparkSession.read.parquet(f"{folder}/out").count() == 7


def test_row_counts_of_nothing(loans):
    assert step_row_counts(loans.limit(0), RETURNED).agg(F.sum("rows_out")).first()[0] == 0
    assert step_row_counts(loans, []).count() == 0


def test_events_template(spark):
    rows = spark.createDataFrame([(1, 3, "view", 9.0), (2, 3, "click", 0.5), (3, 8, "click", 2.0), (4, 8, "buy", None)],
                                 "event_id bigint, user_id bigint, event_type string, value double")
    assert [(r.id, r.points) for r in run_steps(rows, clean_events_steps()).collect()] == [(3, 21.0), (2, 8.0)]


def test_unknown_step(loans):
    with pytest.raises(ValueError, match="unknown step kind"):
        run_steps(loans, [{"kind": "explode"}])
    assert run_steps(loans, [{"kind": "explode", "enabled": False}]).count() == 15


@pytest.mark.parametrize("operator,expected", [("==", 1), ("!=", 13), (">", 5), ("<", 8), (">=", 6), ("<=", 9)])
def test_filter_triple(loans, operator, expected):
    known = loans.filter("loan <> 1")
    assert S.filter_rows(known, column="loan", operator=operator, value=10).count() == expected


def test_filter_rules(loans):
    # a condition wins, and NULL is not true
    assert S.filter_rows(loans, "renewals >= 0", column="loan", value=1).count() == 14
    assert S.filter_rows(loans).count() == 15
    with pytest.raises(ValueError, match="unknown operator"):
        S.filter_rows(loans, column="loan", operator="~", value=1)
    with pytest.raises(ValueError, match="unknown column"):
        S.filter_rows(loans, column="nope", value=1)
    assert S.filter_rows(loans, column="reader", value="'; DROP TABLE loans --").count() == 0


def test_drop_null(loans):
    assert S.drop_null(loans, column="due").count() == 13
    assert S.drop_null(loans, ["due", "renewals"]).count() == 12
    assert S.drop_null(loans).count() == 12
    nan = loans.sparkSession.createDataFrame([(float("nan"),), (None,)], "x double")
    assert S.drop_null(nan).count() == 1


def test_deduplicate(loans):
    first = S.deduplicate(loans, ["card"], order_by=["loan"])
    last = S.deduplicate(loans, ["card"], "last", ["loan"])
    assert set(ids(loans)) - set(ids(first)) == {6, 11}
    assert set(ids(loans)) - set(ids(last)) == {2, 4}
    assert first.columns == loans.columns
    assert S.deduplicate(loans.select("shelf")).count() == 4
    with pytest.raises(ValueError, match="needs order_by"):
        S.deduplicate(loans, ["card"])


def test_sample_rows(spark):
    df = spark.range(4000).select(F.col("id"), (F.col("id") % 50).alias("k"))
    picked = S.sample_rows(df, ["id"], 0.25)
    assert 850 < picked.count() < 1150 and sorted(map(tuple, S.sample_rows(df.repartition(7), ["id"], 0.25).collect())) == sorted(map(tuple, picked.collect()))
    assert {r["count"] for r in S.sample_rows(df, ["k"], 0.5).groupBy("k").count().collect()} == {80}
    assert S.sample_rows(df, ["id"], 1).count() == 4000 and S.sample_rows(df, ["id"], 0).count() == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        S.sample_rows(df, ["id"], 2)


def test_deduplicate_nulls_last_both_ways(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("a", 2)], "k string, v int")
    assert S.deduplicate(df, ["k"], "first", ["v"]).first().v == 1
    assert S.deduplicate(df, ["k"], "last", ["v"]).first().v is None


def test_aggregate(loans):
    out = S.aggregate(loans, ["state"], [{"column": "fee", "function": "sum"}, {}])
    assert out.columns == ["state", "sum_fee", "count_*"]
    whole = S.aggregate(loans, [], [{"column": "renewals", "function": "COUNT", "alias": "n"},
                                    {"column": "loan", "function": "FIRST"}, {"column": "renewals", "function": "LAST", "alias": "l"}],
                        order_by=["renewals", "loan"]).first()
    assert (whole["n"], whole["l"]) == (14, None)  # the row without renewals sorts last
    assert S.aggregate(loans, ["shelf"]).count() == 4
    assert S.aggregate(loans, [], [{"column": "fee", "function": "MEDIAN", "alias": "m"}]).count() == 1
    with pytest.raises(ValueError, match="needs order_by"):
        S.aggregate(loans, [], [{"column": "loan", "function": "FIRST"}])


def test_rename_and_derive(loans):
    assert S.rename(loans, {"loan": "number"}).columns[0] == "number"
    with pytest.raises(ValueError, match="unknown column"):
        S.rename(loans, {"nope": "x"})
    assert S.derive(loans).select("kolom_baru").distinct().collect()[0][0] is None
    dotted = S.rename(loans, {"loan": "a.b"})
    assert S.sort_rows(S.drop_null(dotted, ["a.b"]), ["a.b"]).count() == 15


def test_sort_and_limit(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (1, 3)], "v int, id int")
    assert [r.id for r in S.sort_rows(df, ["v"]).collect()] == [3, 2, 1]
    assert [r.id for r in S.sort_rows(df, [{"column": "v", "ascending": False}]).collect()] == [2, 3, 1]
    assert [r.id for r in S.limit_rows(S.sort_rows(df, ["id"]), 1, 1).collect()] == [2]


CASTS = [
    ("int", "1.7", 2), ("int", "-2.5", -3), ("int", " 12 ", 12), ("int", "99999999999", None), ("int", "abc", None),
    ("int", "1e3", 1000), ("bigint", "99999999999", 99999999999), ("date", "31/12/2025", None),
    ("date", "2024-1-2", date(2024, 1, 2)), ("date", "2024/01/02", date(2024, 1, 2)), ("date", "2024", None),
    ("date", "2024-01-02 xyz", None), ("date", "2024-01-02 10:00:00", date(2024, 1, 2)), ("bool", "yes", True),
    ("bool", "t", True), ("bool", "0", False), ("bool", "maybe", None), ("double", "1.5", 1.5), ("double", "1.5d", None),
    ("timestamp", "2024", None), ("text", "x", "x"),
]


@pytest.mark.parametrize("target,text,expected", CASTS)
def test_cast_text(spark, target, text, expected):
    df = spark.createDataFrame([(text,)], "v string")
    assert S.cast_columns(df, {"v": target}).first().v == expected


def test_cast_numbers(spark):
    df = spark.sql("SELECT 2.5D AS a, 3.5D AS b, 2.5BD AS c, double('nan') AS d, 1e20D AS e, '1.23456' AS f, 7 AS keep")
    row = S.cast_columns(df, {"a": "int", "b": "int", "c": "int", "d": "int", "e": "int", "f": "decimal"})
    assert row.columns == df.columns
    assert [str(v) for v in row.first()] == ["2", "4", "3", "None", "None", "1.235", "7"]
    assert resolve_type("DateTime") == "timestamp_ntz" and resolve_type("TINYINT") == "tinyint"


def test_cast_options(spark):
    df = spark.createDataFrame([("31/12/2025",), ("2025-12-31",)], "v string")
    shown = S.cast_columns(df, {"v": "date"}, date_format="dd/MM/yyyy").collect()
    assert [r.v for r in shown] == [date(2025, 12, 31), None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        S.cast_columns(df, {"v": "date"}, strict=True).collect()


def test_batch_edit(spark, loans):
    edits = spark.createDataFrame([
        (1, "branch", "Hill", 1), (1, "branch", "Lake", 2), (2, "renewals", None, 3), (3, "fee", "5.5", 4),
        (4, "no_such", "x", 5), (99, "branch", "x", 6)], "id int, column string, new_value string, seq int")
    out = {r.loan: r for r in batch_edit(loans, edits, "loan").collect()}
    assert len(out) == 15
    assert out[1].branch == "Lake" and out[2].renewals is None and out[3].fee == 5.5
    assert batch_edit(loans, edits, "loan").schema == loans.schema
