"""Table functions and aggregates in SQL; row estimates."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from steplake.functions.sql import run_sql
from steplake.functions.sql_functions import register
from steplake.operators.guards import analyze_columns, estimate_rows, estimate_scan


@pytest.fixture(scope="module")
def known(spark):
    register(spark)
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(minutes=m), m) for m in (0, 5, 50, 51, 200)] + [("b", None, 1), ("b", t0, 2), (None, t0, 3)]
    spark.createDataFrame(rows, "k string, at timestamp, n int").createOrReplaceTempView("udtf_rows")
    return spark


def test_sessions_keep_all_columns_of_any_table(known):
    got = run_sql(known, "SELECT * FROM sessions(TABLE(udtf_rows) PARTITION BY k ORDER BY (at), 'at', gap => 1800)")
    assert got.columns == ["k", "at", "n", "session", "since_last"]
    assert sorted((str(r.k), r.n, r.session) for r in got.collect()) == [
        ("None", 3, 1), ("a", 0, 1), ("a", 5, 1), ("a", 50, 2), ("a", 51, 2), ("a", 200, 3), ("b", 1, 1), ("b", 2, 2)]
    with pytest.raises(Exception, match="no column 'when'"):
        run_sql(known, "SELECT * FROM sessions(TABLE(udtf_rows), 'when', 5)")
    with pytest.raises(Exception, match="first argument is a table"):
        run_sql(known, "SELECT * FROM first_rows(1, 5)")


def test_first_rows_and_melted(known):
    got = run_sql(known, "SELECT k, n, place FROM first_rows(TABLE(udtf_rows) PARTITION BY k ORDER BY (n DESC), 2)").collect()
    assert sorted((str(r.k), r.n, r.place) for r in got) == [("None", 3, 1), ("a", 51, 2), ("a", 200, 1), ("b", 1, 2), ("b", 2, 1)]
    assert run_sql(known, "SELECT * FROM first_rows(TABLE(udtf_rows) PARTITION BY k ORDER BY (n), 0)").count() == 0
    got = run_sql(known, "SELECT * FROM melted(TABLE(SELECT k, n, CAST(NULL AS string) AS none, 'x' AS t FROM udtf_rows WHERE n > 50), 'k')").collect()
    assert sorted(map(tuple, got)) == [("a", "n", "200"), ("a", "n", "51"), ("a", "t", "x"), ("a", "t", "x")]
    with pytest.raises(Exception, match="already has a column"):
        run_sql(known, "SELECT * FROM melted(TABLE(SELECT k AS name, n FROM udtf_rows), 'name')")


def test_aggregates(known):
    got = run_sql(known, """SELECT g, weighted_median(v, w) AS m, most_frequent(t, w) AS f FROM VALUES
      ('x', 1.0D, 1, 'b'), ('x', 2.0D, 2, 'a'), ('x', 9.0D, 2, 'b'), ('x', NULL, 50, NULL), ('y', NULL, 1, NULL), ('z', 5.0D, 1, 'q'), ('z', 4.0D, 1, 'p')
      AS t(g, v, w, t) GROUP BY g""").collect()
    assert sorted(map(tuple, got)) == [("x", 2.0, "b"), ("y", None, None), ("z", 4.0, "p")]


def test_row_estimates(known, folder):
    spark = known
    spark.range(20_000).select((F.col("id") % 1000).alias("v"), F.pow(F.col("id") / 20_000, 8.0).alias("skewed"), F.col("id").cast("timestamp").alias("at")
                               ).write.option("path", f"{folder}/t").saveAsTable("estimated_rows")
    try:
        rows = spark.table("estimated_rows")
        analyze_columns(spark, "estimated_rows", ["v", "skewed"])
        for condition in ("v < 100", "skewed > 0.5", "skewed < 0.001 AND v >= 500", "v = 3"):
            true = rows.filter(condition).count()
            assert true / 2 <= estimate_rows(spark.table("estimated_rows").filter(condition)) <= 2 * true, condition
        assert estimate_rows(spark.read.parquet(f"{folder}/t").filter("v < 100")) is None
        assert estimate_scan(rows.filter("v = 1"), count_rows=True).rows == 20_000
        assert spark.conf.get("spark.sql.cbo.enabled") == "false"
    finally:
        spark.sql("DROP TABLE estimated_rows")
