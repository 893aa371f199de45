"""Delimited text with line breaks inside quotes, read by many tasks.

A line break ends a record only outside quotes, and whether a place lies inside depends on all quotes before it. A first pass
counts the quotes of each byte range Spark reads; the running parity over a file's ranges, one row each, tells in which state
each range begins. Then every range joins its own lines to records. The few records that reach over the end of a
range are put together from their pieces. Fields are quoted as RFC 4180 has it: a quote within a field is doubled, and a field with one is quoted.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from steplake.operators.steps import quoted
from steplake.session import ensure_checkpoint_dir

_WHOLE, _HEAD, _TAIL = 0, 1, 2  # a record, the rest of one begun before the range, one that goes on behind it
# candidates of a column's type, narrowest first
_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"  # a time of day would be lost in a date
_TYPES = ["int", "bigint", "double", "date", "timestamp", "boolean"]


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines with the byte range they begin in; within a range they keep their order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _quotes(text, quote: str):
    return F.length(text) - F.length(F.replace(text, F.lit(quote), F.lit("")))


def range_states(lines: DataFrame, quote: str = '"') -> DataFrame:
    """file, start, inside, odd: whether a range begins inside quotes, and whether it turns that round."""
    odd = lines.groupBy("file", "start").agg((F.sum(_quotes("value", quote)) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return odd.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)


_PIECES = "file bigint, start bigint, kind tinyint, first boolean, text string"


def _joined(quote: str):
    """Records of each range from its lines, with the pieces at its ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, inside, head, first, held = None, False, False, False, []

        def out(kind: int, texts) -> pa.RecordBatch:
            nonlocal first
            texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
            marks = np.zeros(len(texts), bool)
            if first and kind != _HEAD and len(texts):
                marks[0], first = True, False
            fill = lambda value, kind_: pa.array(np.full(len(texts), value), kind_)
            return pa.record_batch([fill(here[0], pa.int64()), fill(here[1], pa.int64()), fill(kind, pa.int8()), pa.array(marks), texts],
                                   names=["file", "start", "kind", "first", "text"])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                yield out(_HEAD if head else _TAIL, ["\n".join(held)])
                held = []

        for batch in batches:
            if not batch.num_rows:
                continue
            file, start = np.asarray(batch.column("file")), np.asarray(batch.column("start"))
            cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if here != (file[a], start[a]):
                    yield from closed()
                    here, inside = (file[a], start[a]), bool(batch.column("inside")[int(a)].as_py())
                    head, first = inside, start[a] == 0
                lines = batch.column("value").slice(a, b - a)
                state = (inside + np.cumsum(np.asarray(pc.count_substring(lines, quote)))) % 2
                inside = bool(state[-1])
                ends = np.flatnonzero(state == 0) + 1
                if not len(ends):
                    held += lines.to_pylist()
                    continue
                if held or head:
                    yield out(_HEAD if head else _WHOLE, ["\n".join(held + lines.slice(0, ends[0]).to_pylist())])
                    held, head, at = [], False, 1
                else:
                    at = 0
                bounds = np.concatenate([[0], ends])[at:]
                if len(bounds) > 1:
                    inner = lines.slice(bounds[0], bounds[-1] - bounds[0])
                    yield out(_WHOLE, pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), inner), "\n"))
                held = lines.slice(ends[-1]).to_pylist()
        if here is not None:
            yield from closed()
    return run


def csv_records(spark: SparkSession, path, quote: str = '"') -> DataFrame:
    """first, text: every record of the files as text, and whether it is its file's first. Blank lines between records are left out.

    What is sent to all tasks is a number and a place for each byte range that begins inside quotes, whatever the files' content.
    """
    lines = _lines(spark, path)
    ensure_checkpoint_dir(spark)
    states = range_states(lines, quote).checkpoint()
    within = states.filter("inside").select(F.col("file").alias("__file"), F.col("start").alias("__start"), "inside")
    known = lines.join(F.broadcast(within), (F.col("file") == F.col("__file")) & (F.col("start") == F.col("__start")), "left")
    pieces = known.select("value", "file", "start", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(_joined(quote), _PIECES)
    records = pieces.filter(F.col("kind") == _WHOLE).select("first", "text")
    if not states.filter("odd = 1").isEmpty():  # without any, no record crosses a range
        # a piece at a range's end opens a record; what follows up to the next such piece belongs to it
        order = [F.col("start"), F.col("kind")]
        opened = F.sum((F.col("kind") == _TAIL).cast("int")).over(Window.partitionBy("file").orderBy(*order))
        crossing = pieces.filter(F.col("kind") != _WHOLE).withColumn("record", opened)
        parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))), lambda p: p["text"])
        records = records.unionByName(crossing.groupBy("file", "record").agg(F.max("first").alias("first"), F.array_join(parts, "\n").alias("text"))
                                      .select("first", "text"))
    text = F.regexp_replace("text", "\r$", "")
    return records.select("first", F.when(F.col("first"), F.regexp_replace(text, "^﻿", "")).otherwise(text).alias("text")).filter("text <> ''")


def _inferred(fields: DataFrame) -> T.StructType:
    """Per column the first type that holds every value."""
    def misfit(c: str, kind: str):
        fits = quoted(c).try_cast(kind).isNotNull()
        return F.count_if(quoted(c).isNotNull() & ~(fits & quoted(c).rlike(_DAY) if kind == "date" else fits))

    checks = [misfit(c, t).alias(f"{i}:{t}") for i, c in enumerate(fields.columns) for t in _TYPES]
    bad = fields.agg(*checks, *[F.count(quoted(c)).alias(f"{i}:n") for i, c in enumerate(fields.columns)]).first()
    chosen = [next((t for t in _TYPES if bad[f"{i}:n"] and not bad[f"{i}:{t}"]), "string") for i in range(len(fields.columns))]
    return T.StructType([T.StructField(c, T.StructType.fromDDL(f"x {t}")[0].dataType) for c, t in zip(fields.columns, chosen)])


def read_quoted_csv(spark: SparkSession, path, sep: str = ",", header: bool = True, schema: T.StructType | str | None = None,
                    quote: str = '"') -> DataFrame:
    """Typed rows of :func:`csv_records`. Types are inferred in an extra pass unless a schema is given; an empty field is NULL, a
    quoted empty field is ''. A record that does not fit the schema has NULLs."""
    records = csv_records(spark, path, quote)
    options = {"sep": sep, "quote": quote, "escape": quote, "nullValue": "\x00", "maxCharsPerColumn": "-1"}
    rows = records.filter("NOT first") if header else records
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None:
        sample = records.filter("first").agg(F.min("text")).first()[0]
        names = next(csv.reader([sample], delimiter=sep, quotechar=quote), []) if sample else []
        if not header:
            names = [f"_c{i}" for i in range(len(names))]
        if not names:
            return spark.createDataFrame([], T.StructType([]))
        texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
        schema = _inferred(rows.select(F.from_csv("text", _ddl(texts), options).alias("r")).select("r.*"))
    return rows.select(F.from_csv("text", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{_name(f.name)} {f.dataType.simpleString()}" for f in schema)


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
