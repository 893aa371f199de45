"""Joins, windows and quantiles against brute force, with keys that hold a third of all rows."""

import bisect
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from steplake.operators import summary
from steplake.operators.joins import as_of_join, full_join, hot_keys, range_join
from steplake.operators.summary import describe, quantiles, ratio_to_mean
from steplake.operators.windows import framed, running


def keyed_rows(n, seed, keys=6, span=1000):
    """Key 0 holds about a third of the rows; some keys are NULL."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rng.random() < 0.35 else rng.randrange(1, keys)
        out.append((i, None if rng.random() < 0.05 else key, rng.randrange(span)))
    return out


def test_hot_keys(spark):
    counted = spark.createDataFrame([(i, 1) for i in range(2000)] + [(-1, 900)], "k int, n bigint")
    assert [r.k for r in hot_keys(counted, "n").collect()] == [-1]


@pytest.mark.parametrize("width", [1, 37, 5000])
def test_as_of_join_brute_force(spark, width):
    left, right = keyed_rows(400, 1), keyed_rows(150, 2)
    # one right row per key and time, as an as-of join wants it
    right = list({(k, t): (i, k, t) for i, k, t in right}.values())
    out = as_of_join(spark.createDataFrame(left, "id int, k int, t int"),
                     spark.createDataFrame(right, "rid int, k int, rt int"), "t", ["k"], width, "rt").collect()
    assert len(out) == len(left)
    for row in out:
        best = max((t, i) for i, k, t in right + [(None, row.k, -1)] if k == row.k and k is not None and t <= row.t) \
            if row.k is not None else (-1, None)
        assert row.rid == best[1], row


def test_as_of_join_without_keys_and_with_times(spark):
    t0 = datetime(2024, 1, 1)
    left = spark.createDataFrame([(i, t0 + timedelta(hours=5 * i)) for i in range(20)], "id int, t timestamp_ntz")
    right = spark.createDataFrame([(i, t0 + timedelta(hours=7 * i, microseconds=1)) for i in range(10)], "rid int, rt timestamp_ntz")
    out = {r.id: r.rid for r in as_of_join(left, right, "t", [], 86400, "rt").collect()}
    marks = [7 * 3600 * i + 1e-6 for i in range(10)]
    for i in range(20):
        at = bisect.bisect_right(marks, 5 * 3600 * i)
        assert out[i] == (at - 1 if at else None)


def test_as_of_join_refuses_clashing_names(spark):
    df = spark.range(3).select("id", F.lit(1).alias("k"))
    with pytest.raises(ValueError, match="rename"):
        as_of_join(df, df, "id", ["k"], 10)


def test_range_join_brute_force(spark):
    rng = random.Random(3)
    points = keyed_rows(300, 4)
    spans = [(i, rng.randrange(6), s, s + rng.randrange(-2, 90)) for i, s in enumerate(rng.randrange(1000) for _ in range(60))]
    got = range_join(spark.createDataFrame(points, "id int, k int, t int"),
                     spark.createDataFrame(spans, "sid int, k int, a int, b int"), "t", "a", "b", 25, ["k"])
    want = sorted((p[0], s[0]) for p in points for s in spans if p[1] == s[1] and s[2] <= p[2] <= s[3])
    assert sorted((r.id, r.sid) for r in got.collect()) == want and want


def test_running_equals_ordinary_windows(spark):
    rows = [(i, k, t, None if i % 13 == 0 else i % 7) for i, k, t in keyed_rows(500, 5, span=90)]
    df = spark.createDataFrame(rows, "id int, k int, t int, v int")
    df.createOrReplaceTempView("w_rows")
    want = spark.sql("""SELECT id, row_number() OVER w AS rn, rank() OVER r AS rk, dense_rank() OVER r AS dr,
        sum(v) OVER w AS s, lag(v) OVER w AS lg, lead(v) OVER w AS ld, lag(id) OVER w AS lid FROM w_rows
        WINDOW w AS (PARTITION BY k ORDER BY t, id), r AS (PARTITION BY k ORDER BY t)""")
    one = running(df, ["k"], ["t", "id"], "floor(t / 10)", row_number="rn", sums={"s": "v"},
                  lags={"lg": "v", "lid": "id"}, leads={"ld": "v"})
    got = running(one, ["k"], ["t"], "floor(t / 10)", rank="rk", dense_rank="dr").select(*want.columns)
    split_ties = running(df, ["k"], ["t", "id"], "struct(t, floor(id / 50))", row_number="rn").select("id", "rn")
    assert sorted(map(tuple, split_ties.collect())) == sorted((r.id, r.rn) for r in want.collect())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_over_everything(spark):
    df = spark.range(100).select("id", (F.col("id") % 9).alias("v"))
    got = running(df, [], ["id"], "floor(id / 7)", row_number="rn", sums={"s": "v"}).orderBy("id").collect()
    assert [r.rn for r in got] == list(range(1, 101))
    assert got[-1].s == sum(i % 9 for i in range(100))


@pytest.mark.parametrize("shape", ["spread", "one value", "two values", "skewed", "tiny"])
def test_quantiles(spark, shape):
    rng = np.random.default_rng(7)
    values = {"spread": rng.normal(size=3000), "one value": np.full(500, 4.0),
              "two values": np.repeat([1.0, 9.0], [999, 1]), "skewed": np.exp(rng.normal(size=3000) * 6),
              "tiny": np.array([3.0, 1.0])}[shape]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [(None, 1.0), (None, 2.0), ("b", None)], "g string, v double")
    wanted = [0.0, 0.013, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.g, r.probability): r.quantile for r in quantiles(df, "v", wanted, ["g"]).collect()}
    for p in wanted:
        assert got["a", p] == pytest.approx(np.quantile(values, p), rel=1e-9)
        assert got[None, p] == pytest.approx(1 + p)
    assert len(got) == 2 * len(wanted)


def test_quantiles_when_the_brackets_miss(spark, monkeypatch):
    monkeypatch.setattr(summary, "_MARGIN", 0.0)
    monkeypatch.setattr(summary, "_ACCURACY", 3)
    values = np.random.default_rng(1).normal(size=2000)
    df = spark.createDataFrame([("a" if i % 3 else None, float(v)) for i, v in enumerate(values)], "g string, v double")
    got = {(r.g, r.probability): r.quantile for r in quantiles(df, "v", [0.1, 0.5, 0.8], ["g"]).collect()}
    for p in (0.1, 0.5, 0.8):
        assert got["a", p] == pytest.approx(np.quantile([v for i, v in enumerate(values) if i % 3], p))
        assert got[None, p] == pytest.approx(np.quantile(values[::3], p))


def test_framed_equals_ordinary_windows(spark):
    df = spark.createDataFrame([(i, k, t) for i, k, t in keyed_rows(400, 6, span=60)], "id int, k int, t int")
    df.createOrReplaceTempView("f_rows")
    want = spark.sql("""SELECT id, sum(t) OVER w AS s, count(*) OVER w AS n, min(id) OVER w AS m FROM f_rows
        WINDOW w AS (PARTITION BY k ORDER BY t, id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""")
    got = framed(df, ["k"], ["t", "id"], "floor(t / 7)", 3, 2, {
        "s": F.sum("t"), "n": F.count(F.lit(1)), "m": F.min("id")}, chunk=5).select("id", "s", "n", "m")
    assert df.count() == got.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_full_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z"), (1, "w")], "j int, r string")
    want = left.join(right, left.k == right.j, "full")
    assert sorted(map(repr, full_join(left, right, ["k"], ["j"]).collect())) == sorted(map(repr, want.collect()))


def test_quantiles_of_whole_table(spark):
    got = quantiles(spark.range(101), "id", [0.5, 0.905]).collect()
    assert sorted((r.probability, r.quantile) for r in got) == [(0.5, 50.0), (0.905, 90.5)]


def test_quantiles_of_a_heavy_tail(spark, monkeypatch):
    """Narrowed again and again, with one value in a third of the rows, values far out and infinite ones."""
    monkeypatch.setattr(summary, "_SORTED_ROWS", 40)
    rng = random.Random(8)
    values = [rng.random() for _ in range(4000)] + [0.5] * 2000 + [1e12, -1e12, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    wanted = [0.0, 0.0002, 0.1, 0.3333, 0.5, 0.97, 0.9999, 1.0]
    got = {r.probability: r.quantile for r in quantiles(df, "v", wanted).collect()}
    ordered = sorted(values)
    for p in wanted:
        at = (len(values) - 1) * p
        low, high = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)] if at > int(at) else ordered[int(at)]
        assert got[p] == (low if low == high else pytest.approx(low + (high - low) * (at - int(at)))), p


def test_describe_and_ratio(spark):
    df = spark.createDataFrame([(1, 10.0, None), (2, None, None), (3, 30.0, None)], "id int, v double, none double")
    rows = {r["column"]: r for r in describe(df).collect()}
    assert rows["v"]["count"] == 2 and rows["v"]["q50"] == 20.0 and rows["id"]["std"] == 1.0
    assert rows["none"]["count"] == 0 and rows["none"]["q50"] is None
    assert [r.ratio for r in ratio_to_mean(df, "v").orderBy("id").collect()] == [0.5, None, 1.5]


def test_as_of_join_ignores_right_rows_without_time_or_key(spark):
    left = spark.createDataFrame([(1, 10), (2, None), (None, 5)], "k int, t int")
    right = spark.createDataFrame([(1, None, 99), (None, 1, 98), (2, 3, 97)], "k int, rt int, v int")
    got = as_of_join(left, right, "t", ["k"], 5, "rt").collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, None), (1, None), (2, None)]


def test_range_join_of_very_long_intervals(spark):
    points = spark.createDataFrame([(i, v) for i, v in enumerate([0, 7, 10**9, 4 * 10**9, 6 * 10**9])], "p int, x bigint")
    spans = spark.createDataFrame([(0, 0, 5 * 10**9), (1, 7, 7), (2, 10**9 - 3, 10**9 + 3), (3, 9, 8)], "s int, a bigint, b bigint")
    got = sorted((r.p, r.s) for r in range_join(points, spans, "x", "a", "b", 1).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 2), (3, 0)]


def test_frames_wider_than_a_chunk(spark):
    df = spark.range(50).select("id", F.lit(1).alias("k"), (F.col("id") * 3 % 7).alias("v"))
    got = framed(df, ["k"], ["id"], "floor(id / 10)", 30, 20, {"s": F.sum("v"), "n": F.count("v")}, chunk=4).collect()
    for r in got:
        near = [i * 3 % 7 for i in range(50) if r.id - 30 <= i <= r.id + 20]
        assert (r.s, r.n) == (sum(near), len(near))
