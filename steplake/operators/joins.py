"""Joins Spark has no operator for, written so that one busy key cannot fill one task."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from steplake.operators.steps import quoted, require_columns
from steplake.operators.stretches import ROWS, nulls_last, numbered_by, sampled_cuts, tie_breaker, with_stretch


def hot_keys(counted: DataFrame, count: str, share: int = 1000) -> DataFrame:
    """The keys that hold more than one ``share``-th of all rows, from a table with one row per key.

    There are fewer than ``share`` of them whatever the table's size, so the
    result is safe to broadcast.
    """
    total = counted.agg(F.sum(quoted(count))).scalar()
    return counted.filter(quoted(count) * share > total)


def _number(column: Column) -> Column:
    """Seconds for a time, the value itself for a number."""
    return column.cast("timestamp").cast("double")


def _axis(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return _number(quoted(name)) if kind.startswith(("timestamp", "date")) else quoted(name).cast("double")


def as_of_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], width: float | None = None,
               right_on: str | None = None, rows: int = ROWS) -> DataFrame:
    """Each left row with the last right row at or before it (per ``by`` key), NULLs when there is none.

    Beyond ``rows`` rows a key's axis is cut at sampled rows of both sides, so that a stretch holds about so many,
    whether the rows are spread out or come in one burst; ``width`` (seconds for times) cuts it into even parts instead. Within
    a key and a stretch a window carries the last right row forward; the last
    right row of earlier stretches comes from a second window over one row per
    key and stretch. So a key with a third of all rows is sorted in many small
    parts, and nothing is paired up before it is known to match. Of right rows at the same time the largest is taken.
    """
    right_on = right_on or on
    require_columns(left, [on, *by])
    require_columns(right, [right_on, *by])
    payload = [c for c in right.columns if c not in by]
    clash = [c for c in payload if c in left.columns]
    if clash:
        raise ValueError(f"rename the columns on one side first: {', '.join(clash)}")
    keys = [f"__k{i}" for i in range(len(by))]

    def tagged(df, at, side, left_part, right_part):
        even = [F.floor(_axis(df, at) / F.lit(float(width))).alias("__stretch")] if width is not None else []
        return df.select(*[quoted(c).alias(k) for c, k in zip(by, keys)], quoted(at).alias("__at"), F.lit(side).alias("__side"),
                         left_part.alias("__l"), right_part.alias("__r"), *even)

    left_row = F.struct(*map(quoted, left.columns))
    right_row = F.struct(*map(quoted, payload))
    left_type = left.select(left_row.alias("s")).schema[0].dataType
    right_type = right.select(right_row.alias("s")).schema[0].dataType
    lefts = tagged(left, on, 1, left_row, F.lit(None).cast(right_type))
    # a right row without a time or key is no partner
    known = F.lit(True)
    for c in (right_on, *by):
        known = known & quoted(c).isNotNull()
    rights = tagged(right.filter(known), right_on, 0, F.lit(None).cast(left_type), right_row)
    both = lefts.unionByName(rights)
    if width is None:
        total = left.count() + right.count()
        # left rows at one time differ by what they hold; right rows keep the order in which the last one is taken
        tie = F.when(F.col("__side") == 1, tie_breaker(left.select(left_row.alias("__l"))))
        order = F.struct(*nulls_last([F.col("__at")]), "__side", "__r", tie)
        both = with_stretch(both, [F.col(k) for k in keys], order, "__stretch", rows, total)
    # one struct per key and stretch, so that all steps below share one shuffle of the rows
    both = both.select(F.struct(*keys, F.col("__stretch").alias("s")).alias("__cell"), "__at", "__side", "__l", "__r")

    inside = Window.partitionBy("__cell").orderBy("__at", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("__near", F.last("__r", ignorenulls=True).over(inside)).filter("__side = 1")

    # one row per key and stretch
    lasts = both.groupBy("__cell").agg(
        F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__at", "__r"))).alias("__last"))
    earlier = (Window.partitionBy(*[F.col("__cell")[k] for k in keys]).orderBy(F.col("__cell")["s"])
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = lasts.select(F.col("__cell").alias("__from"), F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))

    joined = local.join(carried, F.col("__cell") == F.col("__from"), "left")
    # a left row without a time or key has no partner, but stays
    known = F.col("__at").isNotNull()
    for k in keys:
        known = known & F.col("__cell")[k].isNotNull()
    match = F.when(known, F.coalesce("__near", "__carried"))
    return joined.select("__l", match.alias("__m")).select(
        *[F.col("__l")[c].alias(c) for c in left.columns], *[F.col("__m")[c].alias(c) for c in payload])


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: float,
               by: Sequence[str] = ()) -> DataFrame:
    """Pairs where ``start <= point <= end`` (and the ``by`` columns agree), without a nested loop.

    An interval is repeated once per stretch it touches, so the join is an
    equality on key and stretch. Stretches of level n are ``width * 2**n`` long and an
    interval takes the level of its own length, so it touches three at most; a point
    stands in one stretch of each level that occurs. Choose a width near the usual interval.
    """
    require_columns(points, [point, *by])
    require_columns(intervals, [start, end, *by])
    first, last, size = _axis(intervals, start), _axis(intervals, end), F.lit(float(width))
    level = F.greatest(F.lit(0), F.ceil(F.log2((last - first) / size))).cast("int")
    level = F.when(last - first > size, level).otherwise(0)
    sized = intervals.filter(quoted(start) <= quoted(end)).withColumn("__level", level)
    # at most as many levels as a double has exponents
    levels = sorted(r["__level"] for r in sized.select("__level").distinct().collect()) or [0]

    def cell(axis: Column) -> Column:
        return F.floor(axis / (size * F.pow(F.lit(2.0), F.col("__level"))))

    spread = sized.withColumn("__stretch", F.explode(F.sequence(cell(first), cell(last))))
    if len(levels) == 1:  # points stay as they are
        level_of = F.lit(levels[0])
    else:
        level_of = F.explode(F.array(*map(F.lit, levels)))
    cut = points.withColumn("__level", level_of).withColumn("__stretch", cell(_axis(points, point)))
    joined = cut.join(spread, [*by, "__level", "__stretch"])
    return joined.filter((quoted(point) >= quoted(start)) & (quoted(point) <= quoted(end))).drop("__level", "__stretch")


_DEPTH = 500  # starts of a cell of the overlap join, on average
_CELL_CUTS = 50_000  # beyond so many cuts of a side, which Python workers hold whole, cells get deeper
_CELL_SPANS = 100_000  # intervals that meet a cell's starts in one place
_TASKS = 10_000
_TASK_MEETINGS = 20_000_000  # times that a start meets an interval in one task, about


def _cells(cuts: Sequence[tuple[int, Sequence[float]]]) -> Callable[..., Column]:
    """(number of the key's cuts, from, to) -> how many of these cuts lie before ``from``, and how many not behind ``to``; 0 and 0 for a key without."""
    numbers = np.array([n for n, _ in cuts], np.int64)
    order = np.argsort(numbers)
    sizes = np.array([len(cuts[i][1]) for i in order], np.int64)
    values = np.concatenate([np.asarray(cuts[i][1], np.float64) for i in order])
    # one ascending list for all keys: a key's place, then the cut's place among all different cuts
    axis = np.unique(values)
    ends = np.cumsum(sizes)
    numbers, begins, step = numbers[order], ends - sizes, len(axis) + 1
    keyed = np.repeat(np.arange(len(sizes)), sizes) * step + np.searchsorted(axis, values)

    @F.arrow_udf("struct<first int, last int>")
    def place(number: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        cut = np.asarray(number.is_valid())
        of = np.minimum(np.searchsorted(numbers, np.asarray(number.fill_null(0))), len(numbers) - 1)
        found = [np.where(cut, np.searchsorted(keyed, of * step + np.searchsorted(axis, np.asarray(at), side)) - begins[of], 0)
                 for at, side in ((start, "left"), (end, "right"))]
        return pa.StructArray.from_arrays([pa.array(f.astype(np.int32)) for f in found], ["first", "last"])
    return place


def overlap_join(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str,
                 by: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Pairs of intervals that share a point, ends included (and the ``by`` columns agree), without a nested loop or a distinct.

    Of two such intervals one starts inside the other, so a pair is a start inside an interval: a right start not before the left one, or
    a left start behind the right one. The axis of a key is cut at sampled starts of the side whose starts are looked for, into cells of a few hundred (no more
    than ``rows``). A start stands in one cell, so no pair comes twice, and an interval in every cell it touches: but for the first and the last,
    all it meets there are pairs. So the work grows with the pairs that there are. Many equal starts are dealt to several cells, and the
    intervals of a crowded cell to several parts, each beside all its starts. Intervals without both ends, or that end before they start, overlap nothing.
    """
    require_columns(left, [left_start, left_end, *by])
    require_columns(right, [right_start, right_end, *by])
    clash = [c for c in right.columns if c in left.columns and c not in by]
    if clash:
        raise ValueError(f"rename the columns on one side first: {', '.join(clash)}")
    keys = [f"__k{i}" for i in range(len(by))]

    def ends(df, start, end, name):
        known = functools.reduce(Column.__and__, [quoted(c).isNotNull() for c in by], quoted(start) <= quoted(end))
        return df.filter(known).select(*[quoted(c).alias(k) for c, k in zip(by, keys)], _axis(df, start).alias(f"{name}from"), _axis(df, end).alias(f"{name}to"),
                                       *[quoted(c).alias(f"{name}{i}") for i, c in enumerate(df.columns)])

    def met(spans, span, starts, start):
        """The rows of ``spans`` beside those of ``starts`` that stand in the same cell."""
        tie, total = tie_breaker(starts), starts.count()
        depth = max(min(rows, _DEPTH), total // _CELL_CUTS)
        cuts = sampled_cuts(starts, [F.col(k) for k in keys], F.col(f"{start}from"), depth, total)
        listed = []
        if cuts is not None:  # their order is kept with them, so a number stays the same
            cuts = cuts.withColumn("__number", F.monotonically_increasing_id())
            listed = [(r["__number"], r["__cuts"]) for r in cuts.select("__number", "__cuts").toLocalIterator()]
        place = _cells(listed) if listed else lambda *_: F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))

        def placed(df, begin, end):
            if not listed or not by:  # without keys there is one row of cuts
                numbered = df.withColumn("__number", F.lit(listed[0][0] if listed else 0))
            else:
                numbered = numbered_by(df, cuts.select("__of", "__number"), [F.col(k) for k in keys])
            return numbered.withColumn("__place", place("__number", begin, end)).drop("__number")
        first, last = F.col("__place")["first"], F.col("__place")["last"]
        many = placed(spans, f"{span}from", f"{span}to").withColumn("__cell", F.explode(F.sequence(first, last))).drop("__place")
        # the cuts before a start and those not behind it differ where it is a cut itself; a cell that cannot be NULL is not looked up twice
        one = placed(starts, f"{start}from", f"{start}from").withColumn("__cell", F.coalesce(first + F.pmod(tie, last - first + 1).cast("int"), F.lit(0))).drop("__place")
        at = [*keys, "__cell"]
        if cuts is None:
            return many.join(one, at)
        # what is read says little of how many pairs there are, so tasks are made by how often rows meet
        load = many.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
        most, meetings = load.agg(F.max("__n"), F.sum("__n") * depth).first()
        if (most or 0) > _CELL_SPANS:
            crowded = load.filter(F.col("__n") > _CELL_SPANS).select(*at, F.ceil(F.col("__n") / _CELL_SPANS).cast("int").alias("__parts")).checkpoint()
            parts = F.coalesce("__parts", F.lit(1))
            deal = tie_breaker(spans)
            many = many.join(F.broadcast(crowded), at, "left").withColumn("__part", F.coalesce(F.pmod(deal, parts).cast("int"), F.lit(0))).drop("__parts")
            one = one.join(F.broadcast(crowded), at, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
            at = [*at, "__part"]
        tasks = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min((meetings or 0) // _TASK_MEETINGS, _TASKS))
        return many.repartition(tasks, *at).join(one.repartition(tasks, *at), at)

    one, two = ends(left, left_start, left_end, "__l"), ends(right, right_start, right_end, "__r")
    common = one.select(*keys).unionByName(two.select(*keys)).schema if by else []
    one, two = (df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in common}) for df in (one, two))
    chosen = [*[F.col(f"__l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"__r{i}").alias(c) for i, c in enumerate(right.columns) if c not in by]]
    behind = met(one, "__l", two, "__r").filter((F.col("__rfrom") >= F.col("__lfrom")) & (F.col("__rfrom") <= F.col("__lto")))
    ahead = met(two, "__r", one, "__l").filter((F.col("__lfrom") > F.col("__rfrom")) & (F.col("__lfrom") <= F.col("__rto")))
    return behind.select(*chosen).unionByName(ahead.select(*chosen))


def full_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    """All rows of both sides, paired where the keys agree.

    Spark holds both sides of a key in memory for a full outer join and cannot
    split a busy key. A left join and the right rows without a partner give the
    same rows, and both parts can be split.
    """
    require_columns(left, left_on)
    require_columns(right, right_on)
    same = [quoted(a) == quoted(b) for a, b in zip(left_on, right_on)]
    clash = [c for c in right.columns if c in left.columns]
    if clash:
        raise ValueError(f"rename the columns on one side first: {', '.join(clash)}")
    alone = right.join(left.select(*map(quoted, left_on)), same, "left_anti")
    return left.join(right, same, "left").unionByName(alone, allowMissingColumns=True)
