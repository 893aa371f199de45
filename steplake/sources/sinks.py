"""Writers: files by suffix, exports, documents, and named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steplake.operators.steps import quoted

# Rows an export of each format is meant to hold at most; a caller may hand them over as ``limit``.
EXPORT_ROWS = {"csv": 1_000_000, "tsv": 1_000_000, "json": 1_000_000, "parquet": 100_000_000}


def write_files(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet or JSON by suffix, anything else as CSV."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    elif path.endswith(".json"):
        df.write.mode(mode).json(path)
    else:
        export_csv(df, path, mode=mode)


def _capped(df: DataFrame, limit: int | None) -> DataFrame:
    """A row cap only where the caller asks for one: it brings the capped rows into one task."""
    return df if limit is None else df.limit(limit)


def export_csv(df: DataFrame, path: str, sep: str = ",", limit: int | None = None, mode: str = "overwrite") -> None:
    """Text with a header. NULL is empty and '' is quoted, so both can be told apart again."""
    (_capped(df, limit).write.mode(mode).option("header", True).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("nullValue", "").option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def export_json(df: DataFrame, path: str, limit: int | None = None, mode: str = "overwrite") -> None:
    """One JSON record per line, NULL fields included."""
    _capped(df, limit).write.mode(mode).option("ignoreNullFields", False).json(path)


def export_parquet(df: DataFrame, path: str, limit: int | None = None, mode: str = "overwrite") -> None:
    _capped(df, limit).write.mode(mode).parquet(path)


def write_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON document per line without the fields that are NULL; overwrite removes the old ones."""
    body = F.to_json(F.struct(*map(quoted, df.columns)), {"ignoreNullFields": "true"})
    df.select(body.alias("value")).write.mode(mode).text(path)


def save_as_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """Replace a table or add to it; columns are matched by name."""
    spark = df.sparkSession
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    if mode == "append" and spark.catalog.tableExists(name):
        target = spark.table(name)
        if set(target.columns) != set(df.columns):
            raise ValueError(f"table {name} has other columns: {', '.join(target.columns)}")
        df.select(*map(quoted, target.columns)).write.mode("append").insertInto(name)
        return
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
