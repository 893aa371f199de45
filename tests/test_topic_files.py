"""A topic in files: offsets, bounded reads, restarts, repeated commits."""

import os

import pytest
from pyspark.sql import functions as F

from steplake.streaming import topic_files as t
from steplake.streaming.topics import ENVELOPE, consumer_lag


def messages(spark, first, n, parts=2):
    rows = spark.range(first, first + n, 1, parts).select("id", (F.col("id") % 3).alias("p"), F.timestamp_seconds("id").alias("at"))
    return t.as_messages(rows, "id", "p", "at")


@pytest.fixture()
def topic(spark, folder):
    path = f"{folder}/topic"
    t.append_topic_files(messages(spark, 0, 300, 1), path)
    t.append_topic_files(messages(spark, 300, 150), path)
    return path


def test_offsets_follow_each_other(spark, topic):
    rows = t.read_topic_files(spark, topic)
    assert rows.schema == ENVELOPE and rows.count() == 450
    for p in range(3):
        mine = rows.filter(F.col("partition") == p).orderBy("offset").collect()
        assert [r.offset for r in mine] == list(range(150)) and [int(r.key) for r in mine] == list(range(p, 450, 3))
        assert all(r.value == f'{{"id":{r.key}}}' and int(r.timestamp.timestamp()) == int(r.key) for r in mine)
    assert {r.partition: r.high_watermark for r in t.end_offsets(spark, topic).collect()} == {0: 150, 1: 150, 2: 150}


def test_peek_opens_only_what_it_needs(spark, topic):
    want = [(o, str(3 * o + 1)) for o in range(40, 60)]
    assert sorted((r.offset, r.key) for r in t.peek_files(spark, topic, 1, 40).collect()) == want
    for name in os.listdir(f"{topic}/partition=0"):  # other partitions and later files may even be broken
        open(f"{topic}/partition=0/{name}", "w").write("broken")
    late = sorted(os.listdir(f"{topic}/partition=1"))[1:]
    for name in late:
        open(f"{topic}/partition=1/{name}", "w").write("broken")
    assert late and sorted((r.offset, r.key) for r in t.peek_files(spark, topic, 1, 40).collect()) == want
    plan = t.peek_files(spark, topic, 1, 40)
    assert plan.rdd.getNumPartitions() == 1
    assert t.peek_files(spark, topic, 9, 0).count() == 0 and t.read_topic_files(spark, f"{topic}/none").count() == 0


def test_a_stream_restarts_from_its_committed_offsets(spark, topic, folder):
    def run():
        q = (t.read_topic_files(spark, topic, streaming=True).writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    lag = lambda: {r.partition: r.lag for r in consumer_lag(t.committed_offsets(spark, f"{folder}/ck"), t.end_offsets(spark, topic)).collect()}
    assert lag() == {0: 150, 1: 150, 2: 150}
    assert run() == 450 and lag() == {0: 0, 1: 0, 2: 0}
    t.append_topic_files(messages(spark, 450, 31), topic)
    assert sum(lag().values()) == 31 and run() == 31 and run() == 0
    assert sorted(int(r.key) for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(481))


def test_a_stream_writes_each_batch_once(spark, topic, folder):
    out = f"{folder}/copy"
    source = t.read_topic_files(spark, topic, streaming=True).select("key", "value", "timestamp")
    t.stream_to_topic_files(source, out, f"{folder}/ck2", "copier", partitions=4)
    ends = {r.partition: r.high_watermark for r in t.end_offsets(spark, out).collect()}
    assert sum(ends.values()) == 450 and len(ends) == 4
    last = max(int(n) for n in os.listdir(f"{folder}/ck2/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # as if the query had died between the sink's commit and its own
        os.path.exists(f"{folder}/ck2/commits/{name}") and os.remove(f"{folder}/ck2/commits/{name}")
    t.stream_to_topic_files(source, out, f"{folder}/ck2", "copier", partitions=4)
    assert {r.partition: r.high_watermark for r in t.end_offsets(spark, out).collect()} == ends
    rows = t.read_topic_files(spark, out).collect()
    assert sorted(int(r.key) for r in rows) == list(range(450)) and not os.listdir(f"{out}/_writing")
    assert all(len({r.partition for r in rows if r.key == k}) == 1 for k in ("1", "77"))


def test_refused(spark, topic):
    with pytest.raises(Exception, match="only appended"):
        messages(spark, 0, 1).write.format(t.FORMAT).option("path", topic).mode("overwrite").save()
    with pytest.raises(Exception, match="messages have a value"):
        t.append_topic_files(spark.range(1), topic)
