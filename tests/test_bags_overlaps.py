"""Bag operations by multiplicity and overlaps of intervals, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from steplake.operators import joins
from steplake.operators.bags import except_all, intersect_all
from steplake.operators.joins import overlap_join


@pytest.mark.parametrize("block", [3, 10_000])
def test_bags(spark, block):
    rng = random.Random(block)
    make = lambda n: [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2])) for _ in range(n)] + [("busy", 7)] * (n // 2)
    left, right = make(300), make(180)
    frames = spark.createDataFrame(left, "k string, n int"), spark.createDataFrame(right, "other string, m bigint")
    both, less = Counter(left) & Counter(right), Counter(left) - Counter(right)
    assert Counter(map(tuple, intersect_all(*frames, block=block).collect())) == both
    assert Counter(map(tuple, except_all(*frames, block=block).collect())) == less
    assert intersect_all(*frames).schema == frames[0].schema
    empty = frames[1].filter("false")
    assert Counter(map(tuple, except_all(frames[0], empty).collect())) == Counter(left) and intersect_all(frames[0], empty).count() == 0
    with pytest.raises(ValueError, match="columns on one side"):
        except_all(frames[0], frames[1].select("m"))


def test_copies_are_replayed_in_blocks(spark):
    """A row with many copies is many rows of the plan before it is copied, so no task makes all of them."""
    frame = spark.range(100_000).select((F.col("id") * 0).alias("k"))
    out = intersect_all(frame, frame, block=1000)
    assert out.count() == 100_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2 and "Replicate" not in plan


@pytest.mark.parametrize("rows", [10, 60, 100_000])
def test_overlaps(spark, rows):
    rng = random.Random(rows)

    def spans(n, seed):
        out = []
        for i in range(n):
            k = rng.choice([0, 0, 1, 2, None])
            a = 500 if rng.random() < 0.3 else rng.randrange(1000)  # a burst of starts
            length = rng.choice([0, 3, 40, 800, -5])
            out.append((i + seed, k, None if rng.random() < 0.05 else a, a + length))
        return out
    left, right = spans(150, 0), spans(120, 1000)
    got = overlap_join(spark.createDataFrame(left, "a int, k int, s int, e int"), spark.createDataFrame(right, "b int, k int, x int, y int"),
                       "s", "e", "x", "y", ["k"], rows).collect()
    fits = lambda s, e: s is not None and s <= e
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] is not None and p[1] == q[1] and fits(*p[2:]) and fits(*q[2:]) and p[2] <= q[3] and q[2] <= p[3])
    assert sorted((r.a, r.b) for r in got) == want and len(want) > 500


def test_overlaps_without_keys_and_without_a_nested_loop(spark):
    left = spark.range(50).selectExpr("id AS a", "id * 10 AS s", "id * 10 + 12 AS e")
    right = spark.range(50).selectExpr("id AS b", "id * 10 + 11 AS x", "id * 10 + 15 AS y")
    out = overlap_join(left, right, "s", "e", "x", "y", rows=16)
    assert sorted(map(tuple, out.select("a", "b").collect())) == sorted((a, b) for a in range(50) for b in range(50) if 10 * a <= 10 * b + 15 and 10 * b + 11 <= 10 * a + 12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="rename"):
        overlap_join(left, left, "s", "e", "s", "e")


def test_starts_meet_few_intervals_that_do_not_overlap(spark, monkeypatch):
    """One key with many short intervals and the usual ``rows``: what meets in the cells stays near the pairs, not near the product of both sides."""
    n, met = 8000, []
    left = spark.range(n).selectExpr("id AS a", "0 AS k", "id * 10 AS s", "id * 10 + 12 AS e")
    right = spark.range(n).selectExpr("id AS b", "0 AS k", "id * 10 + 11 AS x", "id * 10 + 15 AS y")
    join = type(left).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if how is None and "__cell" in on:
            met.append(out.count())
        return out
    monkeypatch.setattr(type(left), "join", counted)
    out = overlap_join(left, right, "s", "e", "x", "y", ["k"])
    assert out.count() == 2 * n - 1 and met and sum(met) < n * n / 2


@pytest.mark.parametrize("spans", [7, 100_000])
def test_overlaps_of_crowded_cells_and_bursts(spark, monkeypatch, spans):
    """Long intervals over few starts are dealt to parts, many equal starts to cells; keys agree by value, whatever their type."""
    monkeypatch.setattr(joins, "_CELL_SPANS", spans)
    rng = random.Random(spans)
    left = [(i, rng.choice([0, 1, -1]), s := rng.choice([300, rng.randrange(600)]), s + rng.choice([0, 5, 400])) for i in range(400)]
    right = [(i, rng.choice([0, 1, 7]), s := rng.choice([300, 310, rng.randrange(600)]), s + rng.choice([0, 2, 20])) for i in range(90)]
    got = overlap_join(spark.createDataFrame(left, "a int, k int, s int, e int"), spark.createDataFrame(right, "b int, k bigint, x int, y int"),
                       "s", "e", "x", "y", ["k"], 10).select("a", "b").collect()
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    assert sorted(map(tuple, got)) == want and len(want) > 2000
