"""Message topics: envelope, peeking, typed values, lag and producing. No broker is needed to plan any of it."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from steplake.operators.steps import quoted, require_columns

ENVELOPE = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
])


def topic_options(servers: str, topic: str, start: str = "earliest", end: str | None = None,
                  min_partitions: int | None = None, max_per_batch: int | None = None) -> dict[str, str]:
    """Reader options for a topic; an end makes sense for a bounded read only."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start,
               "includeHeaders": "true"}
    if end is not None:
        options["endingOffsets"] = end
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    if max_per_batch is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_batch)
    return options


def as_envelope(df: DataFrame) -> DataFrame:
    """The columns of the Kafka source in the shape of :data:`ENVELOPE`."""
    headers = F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return df.select("offset", "partition", "timestamp", F.col("key").cast("string").alias("key"),
                     F.col("value").cast("string").alias("value"), headers.alias("headers"))


def read_topic(spark: SparkSession, servers: str, topic: str, streaming: bool = False, **options) -> DataFrame:
    """A topic as a bounded or a streaming table. Reading moves no consumer group."""
    reader = spark.readStream if streaming else spark.read
    return as_envelope(reader.format("kafka").options(**topic_options(servers, topic, **options)).load())


def read_message_files(spark: SparkSession, path: str, streaming: bool = False, pattern: str | None = None) -> DataFrame:
    """Messages that were landed as JSON lines, with the same columns as a topic."""
    reader = (spark.readStream if streaming else spark.read).schema(ENVELOPE)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path)


def peek(messages: DataFrame, partition: int | None = None, limit: int = 20) -> DataFrame:
    """A few messages of one partition (or of all), lowest offset first, as a batch."""
    if messages.isStreaming:
        raise ValueError("peek reads a bounded topic")
    chosen = messages if partition is None else messages.filter(F.col("partition") == partition)
    return chosen.orderBy("offset", "partition").limit(limit)


def peek_topic(spark: SparkSession, servers: str, topic: str, start: dict[int, int], limit: int = 20) -> DataFrame:
    """The next ``limit`` messages of each partition from the offset in ``start`` on; nothing else is read."""
    return as_envelope(spark.read.format("kafka").options(**peek_options(servers, topic, start, limit)).load())


def peek_options(servers: str, topic: str, start: dict[int, int], limit: int = 20) -> dict[str, str]:
    """Reader options that bound a read of a topic on both sides, partition by partition."""
    ends = {p: o + limit for p, o in start.items()}
    options = topic_options(servers, topic, *(json.dumps({topic: {str(p): o for p, o in offsets.items()}}) for offsets in (start, ends)))
    return options | {"failOnDataLoss": "false"}  # an end behind the last message is cut


def parse_values(messages: DataFrame, schema: T.StructType | str, keep: Sequence[str] = ("offset", "partition", "timestamp")
                 ) -> DataFrame:
    """Typed columns of the JSON value beside the envelope; text that does not parse goes to ``_corrupt``."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    require_columns(messages, [*keep, "value"])
    with_bad = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return messages.select(*map(quoted, keep), parsed.alias("v")).select(*map(quoted, keep), "v.*")


def consumer_lag(committed: DataFrame, latest: DataFrame) -> DataFrame:
    """Lag per partition: high watermark minus committed offset (``partition, current_offset`` and
    ``partition, high_watermark``); a partition nobody has read lags by its whole length."""
    current = F.coalesce("current_offset", F.lit(0))
    return latest.join(committed, "partition", "left").select(
        "partition", current.alias("current_offset"), "high_watermark",
        F.greatest(F.col("high_watermark") - current, F.lit(0)).alias("lag"))


def high_watermarks(messages: DataFrame) -> DataFrame:
    """The next offset of every partition."""
    return messages.groupBy("partition").agg((F.max("offset") + 1).alias("high_watermark"))


def total_lag(lag: DataFrame) -> DataFrame:
    return lag.agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("total_lag"))


def to_messages(df: DataFrame, key: str | None = None, partition: str | None = None) -> DataFrame:
    """Rows as messages: the key column as text, the other columns as a JSON value."""
    fields = [c for c in df.columns if c != partition]
    columns = [F.to_json(F.struct(*map(quoted, fields))).alias("value")]
    if key:
        columns.insert(0, quoted(key).cast("string").alias("key"))
    if partition:
        columns.append(quoted(partition).cast("int").alias("partition"))
    return df.select(*columns)


def write_message_files(df: DataFrame, path: str, key: str | None = None, partition: str | None = None,
                        offset: str | None = None, timestamp: str | None = None, mode: str = "append") -> None:
    """Land rows as messages in JSON lines, with the columns of a topic, where no broker is at hand."""
    require_columns(df, [c for c in (key, partition, offset, timestamp) if c])
    fields = [c for c in df.columns if c not in (partition, offset, timestamp)]
    given = {"offset": offset, "partition": partition, "timestamp": timestamp, "key": key}
    columns = [(quoted(c) if c else F.lit(None)).cast(ENVELOPE[name].dataType).alias(name) for name, c in given.items()]
    messages = df.select(*columns, F.to_json(F.struct(*map(quoted, fields))).alias("value"),
                         F.lit(None).cast(ENVELOPE["headers"].dataType).alias("headers"))
    messages.write.mode(mode).json(path)


def write_topic(df: DataFrame, servers: str, topic: str, key: str | None = None, partition: str | None = None,
                checkpoint: str | None = None, read_only: bool = False):
    """Produce rows to a topic: a batch at once, or a stream that returns its running query."""
    if read_only:
        raise PermissionError("the connection is read-only")
    messages = to_messages(df, key, partition)
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if not df.isStreaming:
        messages.write.format("kafka").options(**options).save()
        return None
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder")
    return messages.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint).start()
