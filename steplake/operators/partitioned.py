"""Jobs on folders of partitioned Parquet: append, overwrite, merge, backfill, compaction, and dated snapshots.

A table is a folder as Spark writes it, ``[key=value/...]/*.parquet``. A write first
brings the rows of a partition together, so it makes few files, and replaces whole
partitions in the write's own commit. There is one writer at a time; readers who need
yesterday's rows keep snapshots, which are partitions too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from steplake.operators.steps import quoted, require_columns
from steplake.sources import storage

SNAPSHOT = "snapshot"


def _rebalanced(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a partition together; a large partition is spread over tasks of the session's advisory size."""
    return df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")


def _write(df: DataFrame, path: str, partition_by: Sequence[str], mode: str, rebalance: bool = True) -> None:
    """``overwrite`` replaces the partitions that occur in ``df``; without partition columns the whole folder."""
    require_columns(df, partition_by)
    writer = (_rebalanced(df, partition_by) if rebalance else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of a folder. A schema keeps partition columns from being guessed."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    _write(df, path, partition_by, "append")


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """New rows in place of all old ones, which go when the new ones are complete. ``df`` may read ``path``."""
    spark, old, new = df.sparkSession, f"{path.rstrip('/')}.old", f"{path.rstrip('/')}.new"
    if not storage.exists(spark, path) and storage.exists(spark, old):
        storage.rename(spark, old, path)  # an earlier call stopped between its two renames
    for left_over in (old, new):
        storage.remove(spark, left_over)
    _write(df, new, partition_by, "overwrite")
    if storage.exists(spark, path):
        storage.rename(spark, path, old)
    storage.rename(spark, new, path)
    storage.remove(spark, old)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace exactly the partitions that occur in ``df``; running it twice changes nothing more."""
    if not partition_by:
        raise ValueError("a table without partition columns has no partitions to overwrite")
    _write(df, path, partition_by, "overwrite")


def _staged(df: DataFrame, path: str, part: str = "stage") -> DataFrame:
    """What replaces the rows it is made from has to be written down first."""
    stage = f"{path.rstrip('/')}.{part}"
    df.write.mode("overwrite").parquet(stage)
    return df.sparkSession.read.schema(df.schema).parquet(stage)


def _with_folder(df: DataFrame) -> DataFrame:
    """Rows of a table with the folder their file lies in, as the file system names it, whatever the partition's value."""
    return df.select("*", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("__folder"))


def _swap(staged: DataFrame, path: str, partition_by: Sequence[str], emptied: DataFrame | None = None) -> None:
    """Put the staged rows in place and remove the partitions that lost all their rows."""
    spark = staged.sparkSession
    _write(staged, path, partition_by, "overwrite")
    if emptied is not None:
        for row in emptied.toLocalIterator():
            if not storage.remove_uri(spark, row.folder):
                raise OSError(f"could not remove {row.folder}, whose rows have moved")
    for part in ("stage", "emptied"):
        storage.remove(spark, f"{path.rstrip('/')}.{part}")


def merge(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = (), keep_duplicates: bool = False) -> None:
    """Replace rows with the same key, add the others. A NULL key matches nothing.

    Partitions that hold a matched key or get a row are written again, of the others only
    keys are read. Which ones these are is a table, never a list on the driver.
    """
    if not keys:
        raise ValueError("merge needs keys")
    require_columns(df, [*keys, *partition_by])
    spark = df.sparkSession
    if not keep_duplicates:
        named = df.select(*map(quoted, keys)).dropna()
        repeated = named.groupBy(*map(quoted, keys)).count().filter("count > 1").limit(5).collect()
        if repeated:
            raise ValueError("incoming rows repeat a key: " + "; ".join(str(tuple(r)[:-1]) for r in repeated))
    if not storage.exists(spark, path):
        _write(df, path, partition_by, "overwrite")
        return
    target, incoming, names = _with_folder(read_table(spark, path, df.schema)), df.select(*map(quoted, keys)).distinct(), list(partition_by)
    if not names:
        rest = target.join(incoming, list(keys), "left_anti").select(*map(quoted, df.columns))
        _swap(_staged(rest.unionByName(df), path), path, ())
        return
    hit = target.join(incoming, list(keys), "left_semi").select(*map(quoted, names), "__folder").distinct()
    touched = _aside(hit.drop("__folder").unionByName(df.select(*map(quoted, names))).distinct(), names)
    rest = target.join(touched, _same(target, names), "left_semi").join(incoming, list(keys), "left_anti")
    staged = _staged(rest.select(*map(quoted, df.columns)).unionByName(df), path)
    filled = _aside(staged.select(*map(quoted, names)).distinct(), names)
    emptied = hit.join(filled, _same(hit, names), "left_anti").select(F.col("__folder").alias("folder"))
    _swap(staged, path, names, _staged(emptied, path, "emptied"))


def _aside(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(n).alias(f"__{n}") for n in names])


def _same(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [df[f"`{n}`"].eqNullSafe(F.col(f"`__{n}`")) for n in names]


def backfill(df: DataFrame, path: str, date_column: str, start: str, end: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rebuild every day from start to end in one job and report one run per day.

    Days of the range that have no rows any more become empty; other days
    are not touched. Run ids depend on table and day only.
    """
    if start > end:
        raise ValueError(f"the backfill starts after it ends: {start} > {end}")
    names = list(partition_by) or [date_column]
    if names[0] != date_column:
        raise ValueError(f"the table's first partition column has to be {date_column}")
    spark, text = df.sparkSession, isinstance(df.schema[date_column].dataType, T.StringType)
    day = quoted(date_column) if text else F.date_format(quoted(date_column), "yyyy-MM-dd")
    chosen = df.filter(day.between(start, end))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")).select(
        F.col("day").cast("string").alias("backfill_date"))
    # new rows are complete before any old one goes; then partitions of these days that have none are emptied
    staged, emptied = _staged(chosen, path), None
    if storage.exists(spark, path):
        known = _with_folder(read_table(spark, path, df.schema)).filter(day.between(start, end)).select(*map(quoted, names), "__folder").distinct()
        gone = known.join(_aside(staged.select(*map(quoted, names)).distinct(), names), _same(known, names), "left_anti")
        emptied = _staged(gone.select(F.col("__folder").alias("folder")), path, "emptied")
    _swap(staged, path, names, emptied)
    rows = (read_table(spark, path, df.schema).filter(day.between(start, end))
            .groupBy(day.alias("backfill_date")).agg(F.count(F.lit(1)).alias("rows")))
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return days.join(rows, "backfill_date", "left").select(
        F.concat(F.lit(f"bf-{name}-"), F.replace("backfill_date", F.lit("-"), F.lit(""))).alias("run_id"),
        "backfill_date", F.lit("backfill").alias("trigger"), F.lit("success").alias("status"),
        F.coalesce("rows", F.lit(0)).alias("rows_processed"))


def files(spark: SparkSession, path: str, schema: T.StructType | str, partition_by: Sequence[str] = ()) -> DataFrame:
    """One row per file with rows: partition columns, file, bytes, rows."""
    found = read_table(spark, path, schema).groupBy(
        *map(quoted, partition_by), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return found.agg(F.count(F.lit(1)).alias("rows"))


def compact(spark: SparkSession, path: str, schema: T.StructType | str, partition_by: Sequence[str] = (),
            target_file_size_mb: float = 64) -> dict[str, int]:
    """Write partitions with more files than their size needs again, as files of about the target size."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, target = list(partition_by), target_file_size_mb * 1024 * 1024
    before = files(spark, path, kind, names)
    total = before.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    sizes = before.groupBy(*map(quoted, names)).agg(F.count(F.lit(1)).alias("__files"), F.ceil(F.sum("bytes") / F.lit(target)).alias("__wanted"))
    crowded = _staged(sizes.filter("__files > __wanted"), path, "emptied")
    report = {"previous_files_count": total["files"], "new_files_count": total["files"], "total_rows": total["rows"]}
    wanted = crowded.agg(F.sum("__wanted")).first()[0]
    if not wanted:
        storage.remove(spark, f"{path.rstrip('/')}.emptied")
        return report
    rows = read_table(spark, path, kind)
    if names:
        rows = rows.join(crowded.select(*[quoted(n).alias(f"__{n}") for n in names], "__wanted"), _same(rows, names))
    else:
        rows = rows.withColumn("__wanted", F.lit(wanted))
    # rows are dealt to as many files as their partition needs, in turn, whatever their columns hold
    part = F.pmod(F.monotonically_increasing_id(), F.col("__wanted"))
    stage = _staged(rows.select(*map(quoted, kind.names), part.alias("__part")), path)
    dealt = stage.repartition(math.ceil(wanted), *map(quoted, names), "__part").select(*map(quoted, kind.names))
    _write(dealt, path, names, "overwrite", rebalance=False)
    for name in ("stage", "emptied"):
        storage.remove(spark, f"{path.rstrip('/')}.{name}")
    return report | {"new_files_count": files(spark, path, kind, names).count()}


def write_snapshot(df: DataFrame, path: str, number: int) -> None:
    """The whole table as it is now, kept as one numbered partition."""
    overwrite_partitions(df.withColumn(SNAPSHOT, F.lit(number)), path, [SNAPSHOT])


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str, number: int | None = None) -> DataFrame:
    """The newest snapshot, or the newest one up to ``number``."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
    every = read_table(spark, path, T.StructType([*kind.fields, T.StructField(SNAPSHOT, T.IntegerType())]))
    known = [n for n in snapshots(spark, path) if number is None or n <= number]
    if not known:
        raise ValueError(f"{path} has no snapshot" + ("" if number is None else f" up to {number}"))
    return every.filter(F.col(SNAPSHOT) == known[-1]).drop(SNAPSHOT)


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The snapshots' numbers, in order."""
    return sorted(int(n.split("=", 1)[1]) for n, folder, *_ in storage.children(spark, path) if folder and n.startswith(f"{SNAPSHOT}="))


def snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    """snapshot, total_rows of every snapshot, from the files' footers."""
    return spark.read.parquet(path).groupBy(F.col(SNAPSHOT).cast("int").alias(SNAPSHOT)).agg(F.count(F.lit(1)).alias("total_rows"))


def drop_snapshots(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Remove all but the newest ``keep`` snapshots; returns the removed numbers."""
    if keep < 1:
        raise ValueError("at least one snapshot stays")
    old = snapshots(spark, path)[:-keep]
    for number in old:
        storage.remove(spark, f"{path}/{SNAPSHOT}={number}")
    return old
