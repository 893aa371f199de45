"""Stretches of equal depth: bounds, ties, NULLs, bursts."""

import random

import pytest
from pyspark.sql import functions as F

from steplake.operators.joins import as_of_join
from steplake.operators.stretches import nulls_last, with_stretch
from steplake.operators.windows import framed, running


def burst(n, seed):
    """Key 0 has a third of all rows, most of them at one time; some keys and times are NULL."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = 0 if rng.random() < 0.35 else rng.choice([None, 1, 2, 3])
        at = None if rng.random() < 0.05 else 500 if k == 0 and rng.random() < 0.9 else rng.randrange(1000)
        out.append((i, k, at, None if i % 13 == 0 else i % 7))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame(burst(6000, 3), "id int, k int, t int, v int").repartition(5).cache()
    frame.createOrReplaceTempView("burst_rows")
    return frame


def test_no_stretch_is_much_deeper_than_asked(rows):
    order = F.struct(*nulls_last([F.col("t")]), "id")
    cut = with_stretch(rows, [F.col("k")], order, "s", 200)
    depth = cut.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("low"), F.max(order).alias("high"))
    assert depth.agg(F.max("n")).first()[0] <= 400 and depth.filter("k = 0").count() >= 6
    found = sorted(((r.k, r.s), r.low, r.high) for r in depth.filter("k IS NOT NULL").collect())
    for (a, _, high), (b, low, _) in zip(found, found[1:]):
        assert a[0] != b[0] or tuple(high) < tuple(low)  # stretches follow each other in order


def test_small_tables_are_not_cut(rows):
    assert with_stretch(rows, [], F.struct("id"), "s", 6000).select("s").distinct().collect() == [(0,)]
    plan = running(rows, ["k"], ["t", "id"], row_number="rn")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("depth", [50, 700, 10_000])
def test_running_without_a_stretch(spark, rows, depth):
    want = spark.sql("""SELECT id, CAST(row_number() OVER w AS bigint) AS rn, CAST(rank() OVER r AS bigint) AS rk, CAST(dense_rank() OVER r AS bigint) AS dr,
        sum(v) OVER w AS s, lag(v) OVER w AS lg, lead(v) OVER w AS ld, lag(id) OVER w AS lid FROM burst_rows
        WINDOW w AS (PARTITION BY k ORDER BY t NULLS LAST, id), r AS (PARTITION BY k ORDER BY t NULLS LAST)""")
    one = running(rows, ["k"], ["t", "id"], row_number="rn", sums={"s": "v"}, lags={"lg": "v", "lid": "id"}, leads={"ld": "v"}, rows=depth)
    got = running(one, ["k"], ["t"], rank="rk", dense_rank="dr", rows=depth).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    both = running(rows, ["k"], ["t"], rank="rk", row_number="rn", rows=depth)
    assert both.columns == [*rows.columns, "rn", "rk"]
    counts = both.groupBy("k").agg(F.count_distinct("rn").alias("d"), F.count(F.lit(1)).alias("n"), F.max("rn").alias("m"))
    assert all(r.d == r.n == r.m for r in counts.collect())


def test_a_given_stretch_puts_nulls_last_too(spark, rows):
    want = spark.sql("SELECT id, row_number() OVER (PARTITION BY k ORDER BY t NULLS LAST, id) AS rn FROM burst_rows")
    got = running(rows, ["k"], ["t", "id"], "coalesce(floor(t / 50), 1000000)", row_number="rn").select("id", "rn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_frames_without_a_stretch(spark, rows):
    want = spark.sql("""SELECT id, sum(v) OVER w AS s, count(*) OVER w AS n FROM burst_rows
        WINDOW w AS (PARTITION BY k ORDER BY t NULLS LAST, id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""")
    got = framed(rows, ["k"], ["t", "id"], None, 3, 2, {"s": F.sum("v"), "n": F.count(F.lit(1))}, chunk=40, rows=300).select("id", "s", "n")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("depth", [60, 100_000])
def test_as_of_join_without_a_width(spark, depth):
    left, right = burst(900, 1), burst(700, 2)
    out = as_of_join(spark.createDataFrame(left, "id int, k int, t int, v int"), spark.createDataFrame(right, "rid int, k int, rt int, rv int"),
                     "t", ["k"], right_on="rt", rows=depth).collect()
    assert len(out) == len(left)
    for row in out:
        fits = [(rt, rid, rv) for rid, k, rt, rv in right if k is not None and k == row.k and rt is not None and row.t is not None and rt <= row.t]
        at = max((f[0] for f in fits), default=None)
        # of right rows at one time the largest (rid first) is taken
        assert row.rid == max((f[1] for f in fits if f[0] == at), default=None), row


def test_ranks_of_one_value_in_a_third_of_the_rows_are_one_row_of_the_scan(rows):
    plan = running(rows, ["k"], ["t"], rank="rk", rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and plan.count("Window") >= 1
