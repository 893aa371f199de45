"""Sketches of parts against profiles of the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steplake.operators import partitioned, sketches
from steplake.operators.profile import distinct_counts, profile
from steplake.operators.sketches import merge_sketches, read_sketches, refresh_sketches, sketch, sketched_profile

SCHEMA = "p string, n bigint, v double, t string, m map<string,int>, nothing int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = [(f"p{i % 5}" if i % 11 else None, i % 3000, float(x), f"t{i % 7}" if i % 4 else None, {"a": i % 3}, None) for i, x in enumerate(rng.lognormal(size=20_000))]
    out += [("p1", 1, float("nan"), "t", None, None), ("p1", 1, float("inf"), "t", None, None)]
    return spark.createDataFrame(out, SCHEMA).cache()


def test_merged_sketches_equal_a_profile_of_the_whole(rows):
    exact = {r["name"]: r for r in profile(rows.drop("p")).collect()}
    merged = {r["name"]: r for r in sketched_profile(sketch(rows, ["p"])).collect()}
    whole = {r["name"]: r for r in sketched_profile(sketch(rows.drop("p"))).collect()}
    assert list(merged) == list(whole) == list(exact)
    for name, want in exact.items():
        for got in (merged[name], whole[name]):
            for c in ("position", "data_type" if name != "m" else "name", "total_rows", "null_count", "null_pct", "min_value", "max_value"):
                assert got[c] == want[c], (name, c)
            assert abs(got.distinct_count - want.distinct_count) <= 0.03 * want.distinct_count, name
        assert merged[name].distinct_count == whole[name].distinct_count
    assert [merged[c].distinct_count for c in ("t", "m", "nothing")] == [exact[c].distinct_count for c in ("t", "m", "nothing")]
    values = np.sort([r.v for r in rows.filter("v < double('inf')").select("v").collect()])
    for q, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(np.searchsorted(values, merged["v"][q]) / len(values) - share) < 0.02
    bars = np.histogram(values, 8)[0]
    assert np.allclose(merged["v"].histogram, bars / bars.max(), atol=0.03)
    assert merged["nothing"].q50 is None and merged["nothing"].histogram is None and merged["t"].histogram is None


def test_any_subset_and_coarser_parts(rows):
    parts = sketch(rows, ["p"])
    got = {r["name"]: r for r in sketched_profile(parts.filter("p IN ('p1', 'p3')")).collect()}
    want = {r["name"]: r for r in profile(rows.filter("p IN ('p1', 'p3')").drop("p")).collect()}
    assert all((got[c].total_rows, got[c].null_count, got[c].max_value) == (want[c].total_rows, want[c].null_count, want[c].max_value) for c in want)
    assert merge_sketches(parts, ["p"]).count() == parts.count() == 6
    assert sketched_profile(parts.filter("false")).select("total_rows", "distinct_count", "min_value").distinct().collect() == [(0, 0, None)]


def test_refresh_reads_changed_partitions_only(spark, rows, folder, monkeypatch):
    path, kept = f"{folder}/table", f"{folder}/sketches"
    data = rows.select("p", "n", "v")
    partitioned.append(data, path, ["p"])
    here = lambda: spark.read.schema("n bigint, v double, p string").parquet(path)
    assert read_sketches(spark, kept) is None
    assert refresh_sketches(here(), kept, ["p"]) == 6
    assert refresh_sketches(here(), kept, ["p"]) == 0
    partitioned.append(spark.createDataFrame([("p2", 10**6, 1.0), ("new", 5, 2.0), (None, 7, 3.0)], "p string, n bigint, v double"), path, ["p"])
    assert refresh_sketches(here(), kept, ["p"]) == 3
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(f"{folder}/aside")
    from steplake.sources import storage

    storage.remove(spark, f"{path}/p=p4")
    monkeypatch.setattr(sketches, "_LISTED_PARTITIONS", 0)  # joined instead of listed
    partitioned.append(spark.createDataFrame([("p0", 77, 1.5)], "p string, n bigint, v double"), path, ["p"])
    assert refresh_sketches(here(), kept, ["p"]) == 1
    got = {r["name"]: r for r in sketched_profile(read_sketches(spark, kept)).collect()}
    want = {r["name"]: r for r in profile(here().drop("p")).collect()}
    for c in ("n", "v"):
        assert (got[c].total_rows, got[c].null_count, got[c].min_value, got[c].max_value) == (
            want[c].total_rows, want[c].null_count, want[c].min_value, want[c].max_value)
    assert len([n for n in storage.children(spark, kept) if n[0].startswith("generation")]) == 1


def test_a_failing_refresh_leaves_the_old_sketches(spark, rows, folder):
    path, kept = f"{folder}/table", f"{folder}/sketches"
    partitioned.append(rows.select("p", "n"), path, ["p"])
    refresh_sketches(spark.read.parquet(path), kept, ["p"])
    exact = ["name", "total_rows", "null_count", "distinct_count", "min_value", "max_value"]  # quartiles of merged sketches vary a little
    before = sketched_profile(read_sketches(spark, kept)).select(exact).collect()
    partitioned.append(spark.createDataFrame([("p1", 3)], "p string, n bigint"), path, ["p"])
    broken = spark.read.parquet(path).withColumn("bad", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        refresh_sketches(broken, kept, ["p"])
    assert sketched_profile(read_sketches(spark, kept)).select(exact).collect() == before


def test_distinct_counts_through_one_shuffle(spark, rows):
    frame = rows.select("n", "v", "t", "nothing")
    want = frame.agg(*[F.count_distinct(c).alias(c) for c in frame.columns]).first()
    got = distinct_counts(frame, frame.columns)
    assert {r.position: r.distinct_count for r in got.collect()} == dict(enumerate(want))
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,)], "x double")
    assert distinct_counts(odd, ["x"]).first().distinct_count == odd.agg(F.count_distinct("x").alias("n")).first().n == 2
