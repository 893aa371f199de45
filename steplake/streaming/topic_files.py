"""A topic kept as files, as a data source of Spark: offsets per partition, bounded reads, streams, and exactly-once writes.

Where messages are landed in a folder instead of a broker, ``spark.read.format("topic_files")`` reads them with the columns of
a topic. A topic partition is a folder; a file's name says the offset of its first message and how many it holds, so the end of a topic is known from
names, a read between offsets opens the files in between, and a stream's offsets are those of its checkpoint. Writers
take the next offsets when all tasks are done; a micro-batch that is committed again finds its own files and adds none. One writer at a time.

    topic_files.register(spark)
    rows.write.format("topic_files").option("path", path).mode("append").save()
    spark.read.format("topic_files").option("path", path).load().filter("partition = 1 AND offset >= 500 AND offset < 520")

Paths are those that pyarrow can open (local folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)
from pyspark.sql.types import StructType

from steplake.operators.steps import quoted
from steplake.sources import storage
from steplake.streaming.topics import ENVELOPE

FORMAT = "topic_files"
SPLIT_ROWS = 1_000_000  # messages of one task, unless a file holds more
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_FILE = re.compile(r"^(\d{19})-(\d+)-([0-9A-Za-z_-]+)\.parquet$")
_STORED = pa.schema([("timestamp", pa.timestamp("us", "UTC")), ("key", pa.string()), ("value", pa.string()), ("headers", pa.map_(pa.string(), pa.string()))])


@dataclass
class _Piece(InputPartition):
    """Messages of a topic partition from one offset to before another, in files of (first offset, path)."""

    partition: int
    first: int
    last: int
    files: list[tuple[int, str]]


class _Folder:
    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def partitions(self) -> dict[int, list[tuple[int, int, str, str]]]:
        """Per topic partition its files in order: first offset, messages, tag, path."""
        found: dict[int, list] = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            part, name = re.search(r"/partition=(\d+)/[^/]*$", info.path), _FILE.match(info.base_name)
            if part and name:
                found.setdefault(int(part[1]), []).append((int(name[1]), int(name[2]), name[3], info.path))
        return {p: sorted(files) for p, files in found.items()}

    def ends(self) -> dict[int, int]:
        return {p: files[-1][0] + files[-1][1] for p, files in self.partitions().items()}

    def pieces(self, wanted: dict[int, tuple[int, int]] | None, split_rows: int) -> list[_Piece]:
        """The messages between two offsets of each partition, about ``split_rows`` a piece; files outside are left out."""
        out = []
        for p, files in self.partitions().items():
            low, high = (0, 1 << 62) if wanted is None else wanted.get(p, (0, 0))
            held: list[tuple[int, int, str]] = []
            for first, n, _, path in files:
                if first + n > low and first < high:
                    held.append((first, n, path))
                    if sum(x[1] for x in held) >= split_rows:
                        out.append(_piece(p, held, low, high))
                        held = []
            if held:
                out.append(_piece(p, held, low, high))
        return out

    def read(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        for first, path in piece.files:
            with self.fs.open_input_file(path) as handle:
                at = first
                for batch in pq.ParquetFile(handle).iter_batches():
                    low, high = max(piece.first - at, 0), min(piece.last - at, batch.num_rows)
                    if low < high:
                        part = batch.slice(low, high - low)
                        offsets = pa.array(range(at + low, at + high), pa.int64())
                        yield pa.record_batch([offsets, pa.array([piece.partition] * len(offsets), pa.int32()), *(part.column(c) for c in _STORED.names)],
                                              names=["offset", "partition", *_STORED.names])
                    at += batch.num_rows
                    if at >= piece.last:
                        break


def _piece(partition: int, files: Sequence[tuple[int, int, str]], low: int, high: int) -> _Piece:
    return _Piece(partition, max(low, files[0][0]), min(high, files[-1][0] + files[-1][1]), [(f, path) for f, _, path in files])


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split_rows = options["path"], int(options.get("splitRows", SPLIT_ROWS))
        self.partitions_, self.low, self.high = None, 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on partition and offset choose files and places; the rest is left to Spark."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("partition",) and isinstance(f, (EqualTo, In)):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.partitions_ = chosen if self.partitions_ is None else self.partitions_ & chosen
            elif name == ("offset",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif name == ("offset",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == ("offset",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[_Piece]:
        folder = _Folder(self.path)
        wanted = {p: (self.low, self.high) for p in folder.partitions() if self.partitions_ is None or p in self.partitions_}
        # a table without messages still needs one task, which reads none
        return folder.pieces(wanted, self.split_rows) or [_Piece(0, 0, 0, [])]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        return _Folder(self.path).read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.split_rows = options["path"], int(options.get("splitRows", SPLIT_ROWS))
        self.start = options.get("startingOffsets", "earliest")

    def initialOffset(self) -> dict:
        if self.start == "latest":
            return self.latestOffset()
        return {} if self.start == "earliest" else json.loads(self.start)

    def latestOffset(self) -> dict:
        return {str(p): end for p, end in sorted(_Folder(self.path).ends().items())}

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        wanted = {int(p): (int(start.get(p, 0)), int(last)) for p, last in end.items()}
        return _Folder(self.path).pieces(wanted, self.split_rows)

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        return _Folder(self.path).read(partition)


@dataclass
class _Written(WriterCommitMessage):
    """What a task has written: (topic partition, messages, file)."""

    task: int
    files: list[tuple[int, int, str]]


class _Writer:
    """Tasks write messages of each topic partition to files aside; the commit names them after their offsets."""

    def __init__(self, options, schema: StructType):
        self.path, self.shares = options["path"], int(options.get("partitions", 1))
        self.names, self.run = schema.names, options.get("writerId") or uuid.uuid4().hex
        unknown = set(self.names) - set(ENVELOPE.names)
        if unknown or "value" not in self.names:
            raise ValueError(f"messages have a value and columns of {', '.join(ENVELOPE.names)}, not {', '.join(sorted(unknown)) or 'others'}")

    def _partition_of(self, batch: pa.RecordBatch) -> pa.Array:
        """The partition column, else a share by the key's checksum; messages without either go to partition 0."""
        given = batch.column("partition") if "partition" in self.names else pa.nulls(batch.num_rows, pa.int32())
        keys = batch.column("key").cast(pa.string()).to_pylist() if "key" in self.names and given.null_count else []
        made = pa.array([0 if k is None else zlib.crc32(k.encode()) % self.shares for k in keys] or [0] * batch.num_rows, pa.int32())
        return pc.coalesce(given.cast(pa.int32()), made)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        context, folder, open_files = TaskContext.get(), _Folder(self.path), {}
        for batch in iterator:
            if not batch.num_rows:
                continue
            of = self._partition_of(batch)
            stored = pa.table({c: batch.column(c).cast(t) if c in self.names else pa.nulls(batch.num_rows, t) for c, t in zip(_STORED.names, _STORED.types)},
                              schema=_STORED)
            for p in pc.unique(of).to_pylist():
                rows = stored.filter(pc.equal(of, p))
                if p not in open_files:
                    aside = f"{folder.root}/_writing/{self.run}-{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex}-{p}.parquet"
                    folder.fs.create_dir(f"{folder.root}/_writing", recursive=True)
                    open_files[p] = [pq.ParquetWriter(aside, _STORED, filesystem=folder.fs), 0, aside]
                open_files[p][0].write_table(rows)
                open_files[p][1] += rows.num_rows
        for writer, *_ in open_files.values():
            writer.close()
        return _Written(context.partitionId(), [(p, n, aside) for p, (_, n, aside) in sorted(open_files.items())])

    def _commit(self, messages: list[_Written | None], tag: str) -> None:
        folder = _Folder(self.path)
        known = folder.partitions()
        ends = {p: files[-1][0] + files[-1][1] for p, files in known.items()}
        taken = {(p, t) for p, files in known.items() for _, _, t, _ in files}
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for p, n, aside in message.files:
                name = f"{tag}-{message.task}"
                if (p, name) in taken:  # this batch was committed before, all of it or this part
                    folder.fs.delete_file(aside)
                    continue
                first = ends.get(p, 0)
                folder.fs.create_dir(f"{folder.root}/partition={p}", recursive=True)
                folder.fs.move(aside, f"{folder.root}/partition={p}/{first:019d}-{n}-{name}.parquet")
                ends[p] = first + n

    def _drop(self, messages: list[_Written | None]) -> None:
        folder = _Folder(self.path)
        for message in messages:
            for _, _, aside in message.files if message is not None else ():
                folder.fs.delete_file(aside)


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self._commit(messages, self.run)

    def abort(self, messages) -> None:
        self._drop(messages)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self._commit(messages, f"{self.run}-b{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self._drop(messages)


class TopicFiles(DataSource):
    """Options: path; splitRows; startingOffsets of a stream (earliest, latest, or JSON of partition to offset); partitions to deal
    messages to that name none; writerId, the same at each start of a stream, so that a batch is never added twice."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return ENVELOPE

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _BatchWriter:
        if overwrite:
            raise ValueError("a topic is only appended to")
        return _BatchWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        if not self.options.get("writerId"):
            raise ValueError("a stream that writes a topic needs a writerId")
        return _StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicFiles)
    spark.conf.set(_PUSHDOWN, "true")


def read_topic_files(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    register(spark)
    reader = (spark.readStream if streaming else spark.read).format(FORMAT).option("path", path)
    return reader.options(**options).load()


def peek_files(spark: SparkSession, path: str, partition: int, start: int, limit: int = 20) -> DataFrame:
    """The next messages of a partition from an offset on; only the files that hold them are opened."""
    messages = read_topic_files(spark, path)
    return messages.filter((F.col("partition") == partition) & (F.col("offset") >= start) & (F.col("offset") < start + limit))


def append_topic_files(messages: DataFrame, path: str, partitions: int = 1) -> None:
    """Add messages, in the order of tasks and of rows within a task."""
    register(messages.sparkSession)
    messages.write.format(FORMAT).option("path", path).option("partitions", partitions).mode("append").save()


def stream_to_topic_files(messages: DataFrame, path: str, checkpoint: str, writer_id: str, partitions: int = 1, once: bool = True):
    """Add a stream's messages, each micro-batch once, also when it is run again after a failure."""
    register(messages.sparkSession)
    writer = (messages.writeStream.format(FORMAT).option("path", path).option("writerId", writer_id).option("partitions", partitions)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if not once:
        return writer.start()
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def end_offsets(spark: SparkSession, path: str) -> DataFrame:
    """partition, high_watermark from the files' names; no message is read."""
    rows = []
    for name, folder, *_ in storage.children(spark, path):
        if folder and name.startswith("partition="):
            files = [m for n, *_ in storage.children(spark, f"{path}/{name}") if (m := _FILE.match(n))]
            rows.append((int(name.split("=", 1)[1]), max((int(m[1]) + int(m[2]) for m in files), default=0)))
    return spark.createDataFrame(rows, "partition int, high_watermark bigint")


def committed_offsets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """partition, current_offset: how far the stream with this checkpoint has come, by its last finished micro-batch."""
    done = [int(n) for n, *_ in storage.children(spark, f"{checkpoint}/commits") if n.isdigit()]
    found = {}
    if done:
        lines = storage.read_text(spark, f"{checkpoint}/offsets/{max(done)}").splitlines()
        found = json.loads(lines[-1])
    return spark.createDataFrame([(int(p), int(o)) for p, o in found.items()], "partition int, current_offset bigint")


def as_messages(df: DataFrame, key: str | None = None, partition: str | None = None, timestamp: str | None = None) -> DataFrame:
    """Rows as messages: the other columns as a JSON value beside key, partition and time."""
    fields = [c for c in df.columns if c not in (partition, timestamp)]
    given = {"partition": (partition, "int"), "timestamp": (timestamp, "timestamp"), "key": (key, "string")}
    return df.select(*[quoted(c).cast(kind).alias(name) for name, (c, kind) in given.items() if c], F.to_json(F.struct(*map(quoted, fields))).alias("value"))
