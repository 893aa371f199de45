"""Readers for tabular files, chosen by suffix, and import into a named table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from steplake.sources import storage
from steplake.sources.quoted_csv import read_quoted_csv

Schema = StructType | str | None

# Suffixes of supported files and the reader each one needs.
FORMATS = {
    ".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".json": "json",
    ".ndjson": "ndjson", ".jsonl": "ndjson", ".parquet": "parquet",
}
# Content types used when a name has no known suffix.
CONTENT_TYPES = {
    "text/csv": "csv", "text/plain": "csv", "text/tab-separated-values": "tsv",
    "application/json": "json", "application/x-ndjson": "ndjson", "application/vnd.apache.parquet": "parquet",
}
_COMPRESSED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".xz")


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, schema: Schema = None,
             multiline: bool = False) -> DataFrame:
    """Comma- or tab-separated text. Types are inferred in an extra pass unless a schema is given.

    An empty field is NULL, a quoted empty field is ''.

    ``multiline`` reads line breaks inside quotes; large files are still read by many tasks, see :mod:`steplake.sources.quoted_csv`.
    """
    if sep is None:
        sep = "\t" if _suffix(path) == ".tsv" else ","
    if multiline:
        return read_quoted_csv(spark, path, sep, header, schema)
    reader = (spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
              # a text no file holds: Spark reads '' as NULL when it is the mark for NULL
              .option("nullValue", "\x00"))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """One JSON document or array per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_ndjson(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """One JSON object per line."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for ending in _COMPRESSED:
        name = name.removesuffix(ending)
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def detect_format(path: str, content_type: str | None = None) -> str:
    """Format by suffix, else by content type; an error that lists what is supported."""
    found = FORMATS.get(_suffix(path))
    if found is None and content_type:
        found = CONTENT_TYPES.get(content_type.split(";")[0].strip().lower())
    if found is None:
        raise ValueError(f"unsupported file {path!r}; supported: {', '.join(FORMATS)}")
    return found


def read_any(spark: SparkSession, path: str, content_type: str | None = None, schema: Schema = None) -> DataFrame:
    """Read a file or folder with the reader its name asks for."""
    kind = detect_format(path, content_type)
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if kind == "tsv" else ",", schema=schema)
    if kind == "json":
        return read_json(spark, path, schema)
    if kind == "ndjson":
        return read_ndjson(spark, path, schema)
    return read_parquet(spark, path)


def table_name(raw: str) -> str:
    """A safe table name: other characters become ``_``, a leading digit gets a prefix."""
    name = re.sub(r"[^0-9A-Za-z_]", "_", raw)
    return f"t_{name}" if name[:1].isdigit() or not name else name


def import_table(spark: SparkSession, path: str, name: str | None = None, content_type: str | None = None,
                 schema: Schema = None, location: str | None = None) -> DataFrame:
    """Store a file as a table, replacing the old one; returns table_name, row_count, column_count."""
    source = read_any(spark, path, content_type, schema)
    target = table_name(name or path.rstrip("/").rsplit("/", 1)[-1].split(".")[0])
    writer = source.write.mode("overwrite")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(target)
    return spark.table(target).agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(target).alias("table_name"), "row_count", F.lit(len(source.columns)).alias("column_count"))


# Suffixes an object listing shows as tables.
TABULAR = (".parquet", ".csv", ".json")


def list_objects(spark: SparkSession, uri: str) -> DataFrame:
    """One level of a folder or bucket: its folders, and files with a tabular suffix."""
    rows = [(name, "directory" if folder else "table", None if folder else size)
            for name, folder, size, _ in storage.children(spark, uri) if folder or name.endswith(TABULAR)]
    return spark.createDataFrame(rows, "name string, node_type string, size_bytes bigint")


def object_store_options(endpoint: str | None = None, access_key: str | None = None, secret_key: str | None = None,
                         path_style: bool = True) -> dict[str, str]:
    """Hadoop settings for an S3-compatible endpoint, to be given to the session or a reader."""
    options = {"fs.s3a.path.style.access": str(path_style).lower()}
    if endpoint:
        options["fs.s3a.endpoint"] = endpoint
    if access_key:
        options["fs.s3a.access.key"] = access_key
    if secret_key:
        options["fs.s3a.secret.key"] = secret_key
    return options


def read_object_store(spark: SparkSession, uri: str, schema: Schema = None, **connection) -> DataFrame:
    """A parquet, csv or json object below a local path or an ``s3a`` address."""
    if _suffix(uri) not in TABULAR:
        raise ValueError(f"unsupported object {uri!r}; supported: {', '.join(TABULAR)}")
    if connection:
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        for key, value in object_store_options(**connection).items():
            settings.set(key, value)
    return read_any(spark, uri, schema=schema)


def read_log_jsonl(spark: SparkSession, path: str, n: int = 50, time_column: str = "timestamp",
                   schema: Schema = None) -> DataFrame:
    """The newest entries of an audit log, newest first."""
    return read_ndjson(spark, path, schema).orderBy(F.col(time_column).desc_nulls_last()).limit(n)
