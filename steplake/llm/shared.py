"""Small helpers of the operators: tables in the shared folder, packed columns, key buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steplake.session import scratch_path

BUCKET_BYTES = 4 << 20


def written(frame: DataFrame, name: str, *partitions: str) -> DataFrame:
    """The frame, written to the cluster's shared folder and read again: its lineage ends there."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    writer = frame.write.partitionBy(*partitions) if partitions else frame.write
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames nobody holds any more; it does so when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def bucket_count(spark: SparkSession, n_bytes: int) -> int:
    """Buckets of a packed shuffle: a few for each task, and of bounded size however large the input."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES + 1)


def text_bytes(documents: DataFrame, column: str = "text") -> int:
    return documents.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hashes' high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def packed(bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """One (bucket, bytes, bytes, ...) per bucket with entries; entries of a bucket keep their order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    ends = np.append(cut[1:], len(bucket))
    columns = [c[order] for c in columns]
    return [(int(bucket[b]), *(c[b:e].tobytes() for c in columns)) for b, e in zip(cut, ends)]


def unpacked(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """The entries of all blobs of a column, one after the other."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def group_bounds(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start in sorted columns, with the end."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.append(np.flatnonzero(new), n)
