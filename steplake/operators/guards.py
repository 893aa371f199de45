"""Checks before a query runs: how much it would read, and whether it names its partitions."""

from __future__ import annotations

import contextlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T


class ScanTooLarge(RuntimeError):
    """The estimate is over the threshold and nobody confirmed it."""


@dataclass(frozen=True)
class ScanEstimate:
    rows: int | None
    size_bytes: int
    files: int


def estimate_scan(df: DataFrame, max_bytes: int | None = None, confirmed: bool = False,
                  count_rows: bool = False) -> ScanEstimate:
    """Bytes and files Spark would read, without running the query.

    File scans report the files left after partition pruning, other sources the
    optimiser's estimate; filters on other columns are not counted in either.
    ``count_rows`` also counts the rows of all Parquet files behind the query,
    from their footers.
    """
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    size = files = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "FileSourceScanExec":
            chosen = leaf.selectedPartitions()
            size, files = size + chosen.totalFileSize(), files + chosen.totalNumberOfFiles()
        elif leaf.logicalLink().isDefined():
            size += int(str(leaf.logicalLink().get().stats().sizeInBytes()))
    rows = _footer_rows(df) if count_rows and files else None
    if max_bytes is not None and size > max_bytes and not confirmed:
        raise ScanTooLarge(f"the query reads about {size:,} bytes, more than {max_bytes:,}; confirm to run it")
    return ScanEstimate(rows, size, files)


def _footer_rows(df: DataFrame) -> int:
    """Rows of the files behind a query, counted by Spark from their footers; no list of files is made here."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    of_rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(of_rows(spark._jsparkSession, s).count() for s in scans if s.getClass().getSimpleName() == "LogicalRelation")


_COST_BASED = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.planStats.enabled": "true", "spark.sql.statistics.histogram.enabled": "true"}


@contextlib.contextmanager
def _cost_based(spark: SparkSession, **more: str):
    settings = _COST_BASED | {k.replace("__", "."): v for k, v in more.items()}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def analyze_columns(spark: SparkSession, table: str, columns: Sequence[str], bins: int = 254) -> None:
    """Let the catalog keep a table's row count and, for each column, its limits, nulls, distinct values and an equal-height histogram.

    Two passes over the columns, combined on the map side; to be run again when the table has changed much. Spark's estimates
    do not know times without a zone, so these are refused.
    """
    unknown = [c for c in columns if isinstance(spark.table(table).schema[c].dataType, T.TimestampNTZType)]
    if unknown:
        raise ValueError(f"no statistics of times without a zone: {', '.join(unknown)}; cast them to timestamp or date")
    names = ", ".join("`" + c.replace("`", "``") + "`" for c in columns)
    with _cost_based(spark, spark__sql__statistics__histogram__numBins=str(bins)):
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {names}")


def estimate_rows(df: DataFrame) -> int | None:
    """How many rows a query gives, by the optimiser and the statistics of its tables; nothing is run or listed. None where a table has none.

    Filters on analysed columns count with the share of the histogram they leave, joins with their keys' distinct values.
    """
    with _cost_based(df.sparkSession):
        found = df.select("*")._jdf.queryExecution().optimizedPlan().stats().rowCount()
        return int(str(found.get())) if found.isDefined() else None


def _fixed_columns(scan) -> set[str]:
    """The partition columns that a scan compares with values by equality; Spark has split the conditions on AND."""
    fixed, filters = set(), scan.partitionFilters()
    for i in range(filters.size()):
        condition = filters.apply(i)
        kind = condition.getClass().getSimpleName()
        if kind == "EqualTo":
            sides = [condition.left(), condition.right()]
        elif kind == "In":
            sides = [condition.value()]
        elif kind == "InSet":
            sides = [condition.child()]
        else:
            continue
        while any(s.getClass().getSimpleName() == "Cast" for s in sides):
            sides = [s.child() if s.getClass().getSimpleName() == "Cast" else s for s in sides]
        fixed |= {s.name() for s in sides if s.getClass().getSimpleName() == "AttributeReference"}
    return fixed


def require_partition_filter(df: DataFrame, columns: Sequence[str], allow_full_scan: bool = False) -> tuple[bool, str]:
    """Whether every scan of partitioned files fixes one of the columns by equality, and what to say if not.

    Files without partitions, such as small tables joined to the large one, are not judged.
    """
    if allow_full_scan:
        return False, "the query asks for a full scan of the table"
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    scans = [s for s in scans if s.getClass().getSimpleName() == "FileSourceScanExec" and s.relation().partitionSchema().size() > 0]
    if not scans:
        return False, "the query reads no partitioned files"
    if any(not _fixed_columns(s) & set(columns) for s in scans):
        return False, f"the query does not fix a partition column ({', '.join(columns)})"
    return True, "the query reads only the partitions it names"


def read_partitioned(df: DataFrame, columns: Sequence[str], allow_full_scan: bool = False) -> DataFrame:
    """The query itself, refused when it lacks an equality on a partition column."""
    fine, why = require_partition_filter(df, columns)
    if not fine and not allow_full_scan:
        raise ValueError(why)
    return df
