"""What tables exist, how large they are, and a page of their rows."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from steplake.operators.steps import quoted


def page(df: DataFrame, key: Sequence[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of rows in key order; a unique key makes it the same page every time."""
    return df.orderBy(*map(quoted, key)).offset(offset).limit(limit)


def preview(df: DataFrame, key: Sequence[str], limit: int = 100, offset: int = 0) -> dict[str, Any]:
    """A page of rows for display, with the total count and the column types."""
    return {"columns": df.columns, "column_types": [t for _, t in df.dtypes], "total_rows": df.count(),
            "offset": offset, "limit": limit,
            "rows": [list(r) for r in page(df, key, limit, offset).collect()]}


def list_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns, bytes and time of the last change of tables read from files; files without rows do not count."""
    def facts(name, df):
        files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"),
            F.max("_metadata.file_modification_time").alias("changed"))
        return files.agg(
            F.lit(name).alias("table_name"), F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
            F.lit(len(df.columns)).alias("column_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"),
            F.max("changed").alias("updated_at"))
    return functools.reduce(DataFrame.unionByName, [facts(n, d) for n, d in tables.items()])


def table_schema(df: DataFrame) -> DataFrame:
    """Column name, type and nullability in order."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, data_type string, nullable boolean")


def list_catalog(spark: SparkSession) -> DataFrame:
    """Databases, tables and views the session knows, as a flat tree."""
    rows = [(d.name, None, "database") for d in spark.catalog.listDatabases()]
    for database, *_ in list(rows):
        rows += [(database, t.name, "view" if t.tableType in ("VIEW", "TEMPORARY") else "table")
                 for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "database string, name string, node_type string")
