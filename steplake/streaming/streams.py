"""Streams: windows over time, filtering into tables, duplicates, and quality of every micro-batch."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from steplake.operators.quality import Rule, evaluate
from steplake.operators.steps import quoted
from steplake.plans.step_list import Step, run_steps

# step kinds whose result does not depend on rows of other micro-batches
ROW_STEPS = ("filter", "drop_null", "derive", "rename", "cast")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_GROUPS = 1024  # groups of keys of a micro-batch
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; a plain one is read as UTC."""
    return df.withColumn(column, quoted(column).cast("timestamp"))


def throughput(df: DataFrame, time_column: str = "timestamp", window: str = "1 minute", by: Sequence[str] = (),
               lateness: str = "10 minutes") -> DataFrame:
    """Messages per interval. On a stream, rows later than ``lateness`` are dropped."""
    timed = event_time(df, time_column)
    if df.isStreaming:
        timed = timed.withWatermark(time_column, lateness)
    return timed.groupBy(F.window(quoted(time_column), window).alias("w"), *map(quoted, by)).agg(
        F.count(F.lit(1)).alias("messages")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *map(quoted, by), "messages")


def stream_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Row-by-row steps on a stream."""
    wrong = [s.kind for s in steps if s.kind not in ROW_STEPS]
    if wrong:
        raise ValueError(f"not on a stream: {', '.join(wrong)}; use one of {', '.join(ROW_STEPS)}")
    return run_steps(df, steps)


@contextlib.contextmanager
def keyed_state(spark, by_clock: bool = False):
    """Streams started inside keep their state in RocksDB: on disk, changed keys only, however many there are.
    A restarted stream keeps the store its checkpoint names. State that ends ``by_clock`` would call for batches
    without rows forever, so there are none: what has ended leaves with the next rows."""
    settings = {_STORE: _ROCKSDB} | ({_EMPTY_BATCHES: "false"} if by_clock else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _place(row, order_by: Sequence[str]) -> list:
    """Sort key of a row; NULLs come last."""
    return [(row[c] is None, 0 if row[c] is None else row[c]) for c in order_by]


class _FirstRow(StatefulProcessor):
    """Lets the first row of a key pass, and remembers the key."""

    def __init__(self, order_by: Sequence[str], ttl_millis: int | None):
        self.order_by, self.ttl_millis = list(order_by), ttl_millis

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = min(rows, key=lambda row: _place(row, self.order_by))
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def _first_rows(table: pa.Table, keys: Sequence[str], order_by: Sequence[str]) -> pa.Table:
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order_by], null_placement="at_end")
    place = pa.array(range(len(order)), pa.int64())
    sorted_keys = table.select(list(dict.fromkeys(keys))).take(order).append_column("__place", place)
    first = sorted_keys.group_by(list(dict.fromkeys(keys)), use_threads=False).aggregate([("__place", "min")])["__place_min"]
    return table.take(order.take(first))


def _thinned(keys: Sequence[str], order_by: Sequence[str]):
    """Of a key's rows in one Arrow batch only the first goes on, so a busy key costs the shuffle a row a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _first_rows(pa.Table.from_batches([batch]), keys, order_by).to_batches()
    return run


def _firsts(keys: Sequence[str], order_by: Sequence[str], every: int = 1_000_000):
    """Of all rows of some keys, given in Arrow batches, the first row of each key; what is held is thinned whenever ``every`` more rows,
    or as many as were left, have come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left, come = [], 0, 0
        for batch in batches:
            held, come = [*held, batch], come + batch.num_rows
            if come >= max(every, left):
                held = _first_rows(pa.Table.from_batches(held), keys, order_by).to_batches()
                left, come = sum(b.num_rows for b in held), 0
        if come:
            held = _first_rows(pa.Table.from_batches(held), keys, order_by).to_batches()
        yield from held
    return run


def _one_a_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of every key of a micro-batch. Keys go to groups by their hash, so a task holds one group of its keys at a time."""
    thin = df.mapInArrow(_thinned(keys, order_by), df.schema)
    group = F.pmod(F.xxhash64(*map(quoted, keys)), F.lit(_GROUPS))
    return thin.groupBy(group).applyInArrow(_firsts(keys, order_by), df.schema)


def drop_repeats(df: DataFrame, keys: Sequence[str], path: str, checkpoint: str, order_by: Sequence[str] = (),
                 forget_after_millis: int | None = None, once: bool = True):
    """Write the first row of every key, one folder per micro-batch, so a repeated batch replaces its own.

    Which keys were seen is state of the stream, a key each in RocksDB: a micro-batch looks up its own keys and reads
    nothing that earlier ones have written, so its cost does not grow with the history. NULL is a key like any other.
    A key is never forgotten, so late rows with a new key stay and late copies go; ``forget_after_millis`` lets a key go so long after its first row,
    by the clock. Without ``order_by`` any of a key's rows in its first batch is kept; with it the first in that order (NULLs last), so the
    result depends on the batches alone. Rows equal in keys and order are taken for the same row.

    A micro-batch is brought down to a row a key before the state is asked, so keys are looked up by Spark's own operator; only keys that are
    to be forgotten are looked up from Python, one by one.
    """
    names = list(keys)
    if forget_after_millis is not None:
        thin = df.mapInArrow(_thinned(names, order_by), df.schema) if order_by else df
        fresh = thin.groupBy(*map(quoted, names)).transformWithState(
            _FirstRow(order_by, forget_after_millis), df.schema, "append", "ProcessingTime")
    else:
        fresh = (_one_a_key(df, names, order_by) if order_by else df).dropDuplicates(names)

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    with keyed_state(df.sparkSession, forget_after_millis is not None):
        return each_batch(fresh, write, checkpoint, once)


def append_stream(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                  once: bool = True):
    """Append a stream to files, exactly once per checkpoint.

    ``once`` reads what there is and stops; the call then returns when it is done.
    """
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _run(writer, once)


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True,
               output_mode: str = "append"):
    """Call ``handle(rows, batch_id)`` for every micro-batch; a repeated batch has the same id."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(output_mode)
    return _run(writer, once)


def _run(writer, once: bool):
    if not once:
        return writer.start()
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def filter_append(df: DataFrame, condition: str, path: str, checkpoint: str, partition_by: Sequence[str] = ()):
    """Source -> rows that meet a condition -> files."""
    return append_stream(df.filter(condition), path, checkpoint, partition_by)


def stream_quality(df: DataFrame, rules: Sequence[Rule], path: str, checkpoint: str, table_name: str = ""):
    """Judge every micro-batch by the rules; results go to one folder per batch, so a repeat replaces its own."""
    def judge(rows: DataFrame, batch_id: int) -> None:
        evaluate(rows, rules, table_name).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return each_batch(df, judge, checkpoint)


def changed_totals(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Write the rows of a streaming aggregate that a micro-batch changed, one folder per batch, so a repeat replaces its own.

    Intervals behind the watermark leave the state; what was written of them stays. See :func:`newest_totals`.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return each_batch(df, write, checkpoint, once, output_mode="update")


def newest_totals(written: DataFrame, by: Sequence[str]) -> DataFrame:
    """The last value of each interval among all that micro-batches wrote."""
    rest = [c for c in written.columns if c not in (*by, "batch_id")]
    newest = written.groupBy(*map(quoted, by)).agg(F.max_by(F.struct(*map(quoted, rest)), "batch_id").alias("__last"))
    return newest.select(*map(quoted, by), *[F.col("__last")[c].alias(c) for c in rest])
