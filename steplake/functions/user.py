"""User code: a context for scripts, and Python functions over batches and groups."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from steplake.functions.sql import run_sql
from steplake.operators.steps import quoted
from steplake.sources.sinks import save_as_table

DISPLAY_ROWS = 50
_log = logging.getLogger("steplake.user")


class Context:
    """What a user script gets: tables in, tables out, parameters and a log."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None,
                 params: Mapping[str, Any] | None = None, location: str | None = None):
        self.spark = spark
        self.tables = dict(tables or {})
        self.params = dict(params or {})
        self.location = location
        self.written: list[str] = []
        self.messages: list[str] = []
        self.shown: dict[str, Any] | None = None

    def read_table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.table(name)

    def sql(self, text: str) -> DataFrame:
        """SQL over the context's tables, written ``{name}``, and the session's tables."""
        used = {n: df for n, df in self.tables.items() if f"{{{n}}}" in text}
        return run_sql(self.spark, text, None, **used)

    def write_table(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        save_as_table(df, name, mode, f"{self.location}/{name}" if self.location else None)
        self.tables[name] = self.spark.table(name)
        if name not in self.written:
            self.written.append(name)

    def log(self, *parts: Any) -> None:
        line = " ".join(map(str, parts))
        self.messages.append(line)
        _log.info(line)

    def display(self, df: DataFrame) -> None:
        """Keep the first rows for the person who runs the script."""
        rows = df.limit(DISPLAY_ROWS).collect()
        self.shown = {"columns": df.columns, "types": [t for _, t in df.dtypes], "rows": [r.asDict() for r in rows]}


def run_script(context: Context, script: Callable[[Context], DataFrame | None]) -> dict[str, Any]:
    """Run a script given as a function; a DataFrame it returns is shown unless it showed one itself."""
    result = script(context)
    if context.shown is None and result is not None:
        context.display(result)
    return {"tables_written": context.written, "preview": context.shown, "log": context.messages}


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A pandas function over Arrow batches; no shuffle, and no task ever holds more than a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)
    return df.mapInPandas(run, schema)


def map_groups(df: DataFrame, keys: Sequence[str],
               function: Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A function over one group at a time, which receives the group as an iterator of batches.

    The group is never in memory as a whole, but one task reads all of it: use
    :func:`combine_groups` where a group may be very large.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from function(key, batches)
    return df.groupBy(*map(quoted, keys)).applyInPandas(run, schema)


def map_groups_arrow(df: DataFrame, keys: Sequence[str],
                     function: Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                     schema: str) -> DataFrame:
    """:func:`map_groups` on Arrow batches; several times faster where groups are many and small."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(tuple(k.as_py() for k in key), batches)
    return df.groupBy(*map(quoted, keys)).applyInArrow(run, schema)


def combine_groups(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], pd.DataFrame],
                   partial_schema: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user aggregate in two parts: pandas reduces each batch, Spark aggregates merge the parts.

    Only one part per batch and group is shuffled, so a group with a third of all
    rows costs no more than any other.
    """
    reduced = map_batches(df, partial, partial_schema)
    missing = [k for k in keys if k not in reduced.columns]
    if missing:
        raise ValueError(f"the partial result lacks the key(s) {', '.join(missing)}")
    return merge(reduced)
