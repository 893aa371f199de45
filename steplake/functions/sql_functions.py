"""Table functions and aggregates of Python that SQL can call.

    register(spark)
    spark.sql("SELECT * FROM sessions(TABLE(events) PARTITION BY user_id ORDER BY (ts), 'ts', 1800)")
    spark.sql("SELECT k, weighted_median(v, n) FROM (SELECT k, v, count(*) AS n FROM t GROUP BY k, v) GROUP BY k")

A table function learns the columns of its argument when a query is analysed, so one function serves any table. Its rows
come partition by partition as PARTITION BY and ORDER BY of the call ask; state is that of one partition's row before, so a partition of any size streams through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException


def _added(table: AnalyzeArgument, *fields: T.StructField) -> AnalyzeResult:
    """The table's columns and a few more."""
    if not table.isTable:
        raise ValueError("the first argument is a table: name it as TABLE(...)")
    columns = list(table.dataType.fields)
    for f in fields:
        if f.name in table.dataType.names:
            raise ValueError(f"the table already has a column {f.name!r}")
    return AnalyzeResult(T.StructType([*columns, *fields]))


def _constant(argument: AnalyzeArgument, what: str):
    if argument.isTable or argument.value is None:
        raise ValueError(f"{what} has to be a constant")
    return argument.value


class Sessions:
    """sessions(table, time column, gap in seconds): every row with the number of its session within the partition, from 1, and
    the seconds since the row before. A gap longer than the one given starts a session, and so does a row without a time."""

    @staticmethod
    def analyze(table: AnalyzeArgument, time: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        name = _constant(time, "the time column's name")
        if table.isTable and name not in table.dataType.names:
            raise ValueError(f"the table has no column {name!r}")
        if float(_constant(gap, "the gap")) < 0:
            raise ValueError("the gap is not negative")
        return _added(table, T.StructField("session", T.LongType()), T.StructField("since_last", T.DoubleType()))

    def __init__(self):
        self.last, self.number = None, 0

    def eval(self, row, time: str, gap) -> Iterator:
        at = row[time]
        since = (at - self.last).total_seconds() if at is not None and self.last is not None else None
        if since is None or since > gap:
            self.number += 1
        self.last = at
        yield *row, self.number, since


class FirstRows:
    """first_rows(table, n): the first n rows of every partition with their place; the rest of a partition is not even read."""

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if int(_constant(n, "the number of rows")) < 0:
            raise ValueError("the number of rows is not negative")
        return _added(table, T.StructField("place", T.IntegerType()))

    def __init__(self):
        self.place = 0

    def eval(self, row, n: int) -> Iterator:
        self.place += 1
        if self.place > n:
            raise SkipRestOfInputTableException()
        yield *row, self.place


class Melted:
    """melted(table, key columns as text 'a,b'): one row per other column: keys, name and value as text; NULLs are left out."""

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        wanted = [k.strip() for k in _constant(keys, "the list of keys").split(",") if k.strip()]
        missing = [k for k in wanted if table.isTable and k not in table.dataType.names]
        if missing:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        kept = [f for f in table.dataType.fields if f.name in wanted] if table.isTable else []
        made = _added(AnalyzeArgument(dataType=T.StructType(kept), value=None, isTable=table.isTable, isConstantExpression=False),
                      T.StructField("name", T.StringType()), T.StructField("value", T.StringType()))
        return made

    def eval(self, row, keys: str) -> Iterator:
        wanted = {k.strip() for k in keys.split(",")}
        named = row.asDict()
        head = [v for c, v in named.items() if c in wanted]
        for name, value in named.items():
            if name not in wanted and value is not None:
                yield *head, name, str(value)


def _weighted_median(value: pa.Array, weight: pa.Array) -> float | None:
    """The smallest value that, with all smaller ones, has half of the weight; rows without value or weight count for nothing."""
    both = pc.and_(pc.is_valid(value), pc.is_valid(weight))
    value, weight = pc.filter(value, both), pc.filter(weight, both)
    order = pc.sort_indices(value)
    upto = pc.cumulative_sum(weight.take(order).cast(pa.float64()))
    total = upto[-1].as_py() if len(upto) else 0
    at = pc.index(pc.greater_equal(upto, total / 2), True).as_py() if total else -1
    return float(value.take(order)[at].as_py()) if at >= 0 else None


def _most_frequent(value: pa.Array, weight: pa.Array) -> str | None:
    """The value with most weight, the smallest among equals; NULL counts for nothing."""
    sums = pa.table({"v": value, "n": weight}).filter(pc.is_valid(value)).group_by("v", use_threads=False).aggregate([("n", "sum")])
    first = sums.sort_by([("n_sum", "descending"), ("v", "ascending")]).slice(0, 1)
    return first["v"][0].as_py() if len(first) else None


def register(spark: SparkSession) -> None:
    """Make sessions, first_rows, melted, weighted_median and most_frequent known to SQL.

    Spark hands an Arrow aggregate the whole group at once. Count equal values first, as in ``SELECT k, weighted_median(v, n) FROM (SELECT k, v, count(*) AS n
    FROM t GROUP BY k, v) GROUP BY k``: then a group is its distinct values, and the counting combines on the map side.
    """
    for name, function in (("sessions", Sessions), ("first_rows", FirstRows), ("melted", Melted)):
        spark.udtf.register(name, F.udtf(function))
    for name, function, result in (("weighted_median", _weighted_median, float), ("most_frequent", _most_frequent, str)):
        spark.udf.register(name, F.arrow_udf(_annotated(function, result), "double" if result is float else "string"))


def _annotated(function, result: type):
    """Spark knows an Arrow aggregate by annotations that are types."""
    def aggregate(value, weight):
        return function(value, weight)
    aggregate.__annotations__ = {"value": pa.Array, "weight": pa.Array, "return": result}
    return aggregate
