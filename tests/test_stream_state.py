"""Duplicates on a stream, by state kept for each key."""

import random
import time

import pyarrow as pa
import pytest

from steplake.streaming import streams


def _land(spark, folder, rows, parts=1):
    spark.createDataFrame(rows, "k int, at int, v string").repartition(parts).write.mode("append").parquet(f"{folder}/in")


def _stream(spark, folder):
    return spark.readStream.schema("k int, at int, v string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("order_by", [(), ("at",)])
def test_a_batch_costs_the_same_however_long_the_history(spark, folder, order_by):
    for batch in range(20):  # half of each batch are keys of earlier ones
        _land(spark, folder, [(50 * batch + i, 0, "new") for i in range(50)] + [(i, batch, "again") for i in range(50)])
    query = streams.drop_repeats(_stream(spark, folder), ["k"], f"{folder}/out", f"{folder}/ck", order_by)
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 20
    first, last = batches[0], batches[-1]
    assert first["numInputRows"] == last["numInputRows"] == 100  # the only rows a batch reads
    assert last["stateOperators"][0]["numRowsUpdated"] == 50 and last["stateOperators"][0]["numRowsTotal"] == 20 * 50
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == 1000 == out.select("k").distinct().count()
    assert out.groupBy("batch_id").count().select("count").distinct().collect() == [(50,)]


def test_late_rows_restart_and_order(spark, folder):
    """A new start goes on from the checkpoint; of a key's rows in its first batch the first in order stays, NULL times last."""
    _land(spark, folder, [(1, 5, "b"), (1, 3, "a"), (1, None, "n"), (2, None, "n"), (None, 2, "y"), (None, 1, "x")] + [(7, 9, "z")] * 300)
    run = lambda: streams.drop_repeats(_stream(spark, folder), ["k"], f"{folder}/out", f"{folder}/ck", ["at"])
    run()
    _land(spark, folder, [(1, 1, "late copy"), (None, 0, "late copy"), (3, 2, "late key"), (3, -1, "late key first")])
    run()
    run()
    rows = spark.read.parquet(f"{folder}/out").select("k", "at", "v").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(1, 3, "a"), (2, None, "n"), (None, 1, "x"), (7, 9, "z"), (3, -1, "late key first")], key=str)


def test_keys_are_forgotten_on_request(spark, folder):
    run = lambda: streams.drop_repeats(_stream(spark, folder), ["k"], f"{folder}/out", f"{folder}/ck", ["at"], forget_after_millis=1500)
    _land(spark, folder, [(1, 0, "first")])
    run()
    time.sleep(2)
    _land(spark, folder, [(1, 1, "after")])
    run()
    assert sorted(r.v for r in spark.read.parquet(f"{folder}/out").collect()) == ["after", "first"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != streams._ROCKSDB


def test_a_busy_key_is_thinned_before_the_shuffle(spark):
    frame = spark.createDataFrame([(1, i % 7, "v") for i in range(5000)] + [(2, 1, "w"), (None, 1, None)], "k int, at int, v string").coalesce(1)
    thin = frame.mapInArrow(streams._thinned(["k"], ["at"]), frame.schema).collect()
    assert sorted(map(tuple, thin), key=str) == sorted([(1, 0, "v"), (2, 1, "w"), (None, 1, None)], key=str)


@pytest.mark.parametrize("every", [1, 40, 1_000_000])
def test_firsts_of_many_arrow_batches(every):
    rng = random.Random(every)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(50)])) for _ in range(600)] + [(99, 5), (99, None)]
    batches = [pa.RecordBatch.from_pylist([{"k": k, "at": at} for k, at in rows[i:i + 37]], pa.schema([("k", pa.int64()), ("at", pa.int64())])) for i in range(0, len(rows), 37)]
    got = [(r["k"], r["at"]) for b in streams._firsts(["k"], ["at"], every)(iter(batches)) for r in b.to_pylist()]
    want = {k: min((at for key, at in rows if key == k), key=lambda at: (at is None, at or 0)) for k, _ in rows}
    assert len(got) == len(want) and dict(got) == want


def test_keys_in_order_are_looked_up_without_python(spark, folder):
    """A call to Python's state for each key took most of the time: the lookup is Spark's own, on a row a key, whichever tasks a key's rows come from."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, *range(100)]), "v") for _ in range(5000)]
    _land(spark, folder, rows, 7)
    stream = spark.readStream.schema("k int, at int, v string").parquet(f"{folder}/in")
    run = lambda: streams.drop_repeats(stream, ["k"], f"{folder}/out", f"{folder}/ck", ["at"])
    query = run()
    _land(spark, folder, [(k, -1, "late copy") for k in [None, *range(400)]] + [(1000, 8, "late key")], 3)
    last = [p for p in (run()).recentProgress if p["numInputRows"]][-1]
    want = {k: min((at for key, at, _ in rows if key == k), key=lambda at: (at is None, at or 0)) for k, _, _ in rows} | {1000: 8}
    assert sorted(((r.k, r.at) for r in spark.read.parquet(f"{folder}/out").collect()), key=str) == sorted(want.items(), key=str)
    assert [p["stateOperators"][0]["operatorName"] for p in (query.recentProgress[0], last)] == ["dedupe"] * 2
    assert last["stateOperators"][0]["numRowsUpdated"] == 1
