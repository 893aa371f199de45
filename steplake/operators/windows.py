"""Window results for groups of any size: sort short stretches, add what came before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from steplake.operators.steps import quoted, require_columns
from steplake.operators.stretches import ROWS, nulls_last, tie_breaker, with_stretch


def running(df: DataFrame, by: Sequence[str], order_by: Sequence[str], stretch: Column | str | None = None, *,
            row_number: str | None = None, rank: str | None = None, dense_rank: str | None = None,
            sums: Mapping[str, str] | None = None, lags: Mapping[str, str] | None = None,
            leads: Mapping[str, str] | None = None, rows: int = ROWS) -> DataFrame:
    """Ranks, running sums and neighbours per ``by`` group in ascending ``order_by``, NULLs last.

    An ordinary window sorts a whole group in one task. Here a table of more than ``rows`` rows is cut
    into stretches of about so many, at sampled rows of each group: rows are sorted within a stretch, and one
    row per stretch carries counts, sums and edge values across. The result equals the ordinary window. For
    ranks each distinct value is counted first, so a value that fills a third of the table is one row of the scan;
    for the rest rows with an equal order are told apart by their other columns.

    ``stretch``, an expression that never falls as the order rises, such as the hour of a time, replaces the sampled
    cuts where it is known to part the rows well; for ranks it may depend on the order columns only.
    ``sums``, ``lags`` and ``leads`` map a new column to its source column.
    """
    sums, lags, leads = dict(sums or {}), dict(lags or {}), dict(leads or {})
    require_columns(df, [*by, *order_by, *sums.values(), *lags.values(), *leads.values()])
    if stretch is None:
        total = df.count()
        if total <= rows:
            return _plain(df, by, order_by, row_number, rank, dense_rank, sums, lags, leads)
        if rank or dense_rank:
            df, plain = _ranked(df, by, order_by, rank, dense_rank, rows), df.columns
            if not (row_number or sums or lags or leads):
                return df
            added = [c for c in (rank, dense_rank) if c]
            return running(df, by, order_by, row_number=row_number, sums=sums, lags=lags, leads=leads, rows=rows).select(
                *map(quoted, [*plain, *([row_number] if row_number else []), *added, *sums, *lags, *leads]))
        tie = [tie_breaker(df)]
        order = F.struct(*nulls_last([quoted(c) for c in order_by]), *tie)
        base, cut = with_stretch(df, [quoted(c) for c in by], order, "__stretch", rows, total), F.col("__stretch")
    else:
        tie, base, cut = [], df, F.expr(stretch) if isinstance(stretch, str) else stretch
        order = F.struct(*nulls_last([quoted(c) for c in order_by]))
    # One struct per cell: NULL keys match as they do in a window, and grouping,
    # sorting and joining by the same column need a single shuffle of the rows.
    cell = F.struct(*[quoted(c).alias(f"k{i}") for i, c in enumerate(by)], cut.alias("s"))
    rows_ = base.withColumn("__cell", cell)

    parts = [F.count(F.lit(1)).alias("n")]
    if dense_rank:
        parts.append(F.count_distinct(order).alias("d"))
    parts += [F.sum(quoted(c)).alias(f"sum_{a}") for a, c in sums.items()]
    # wrapped, so that a NULL at the edge is carried as a NULL
    parts += [F.max_by(F.struct(quoted(c)), order).alias(f"lag_{a}") for a, c in lags.items()]
    parts += [F.min_by(F.struct(quoted(c)), order).alias(f"lead_{a}") for a, c in leads.items()]
    per_cell = rows_.groupBy("__cell").agg(*parts)

    across = Window.partitionBy(*[F.col("__cell")[f"k{i}"] for i in range(len(by))]).orderBy(F.col("__cell")["s"])
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(
        F.col("__cell").alias("__at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"),
        *([F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("__before_d")] if dense_rank else []),
        *[F.sum(quoted(f"sum_{a}")).over(earlier).alias(f"__sum_{a}") for a in sums],
        *[F.lag(quoted(f"lag_{a}")).over(across).alias(f"__lag_{a}") for a in lags],
        *[F.lead(quoted(f"lead_{a}")).over(across).alias(f"__lead_{a}") for a in leads])

    inside = Window.partitionBy("__cell").orderBy(*_ascending(order_by), *tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    here = {}
    if row_number:
        here["__here"] = F.row_number().over(inside)
    if rank:
        here["__here_rank"] = F.rank().over(inside)
    if dense_rank:
        here["__here_d"] = F.dense_rank().over(inside)
    here |= {f"__here_sum_{a}": F.sum(quoted(c)).over(upto) for a, c in sums.items()}
    here |= {f"__here_lag_{a}": F.lag(F.struct(quoted(c))).over(inside) for a, c in lags.items()}
    here |= {f"__here_lead_{a}": F.lead(F.struct(quoted(c))).over(inside) for a, c in leads.items()}
    joined = rows_.select("*", *[w.alias(a) for a, w in here.items()]).join(offsets, F.col("__cell") == F.col("__at"))

    out = {}
    if row_number:
        out[row_number] = F.col("__here") + F.col("__before")
    if rank:
        out[rank] = F.col("__here_rank") + F.col("__before")
    if dense_rank:
        out[dense_rank] = F.col("__here_d") + F.col("__before_d")
    for alias in sums:
        near, before = quoted(f"__here_sum_{alias}"), quoted(f"__sum_{alias}")
        out[alias] = F.when(near.isNull() | before.isNull(), F.coalesce(near, before)).otherwise(near + before)
    for alias, c in lags.items():
        out[alias] = F.coalesce(quoted(f"__here_lag_{alias}"), quoted(f"__lag_{alias}"))[c]
    for alias, c in leads.items():
        out[alias] = F.coalesce(quoted(f"__here_lead_{alias}"), quoted(f"__lead_{alias}"))[c]
    return joined.select(*map(quoted, df.columns), *[column.alias(a) for a, column in out.items()])


def _ascending(order_by: Sequence[str]) -> list[Column]:
    return [quoted(c).asc_nulls_last() for c in order_by]


def _plain(df: DataFrame, by, order_by, row_number, rank, dense_rank, sums, lags, leads) -> DataFrame:
    """The ordinary window, for tables whose groups fit a sort each."""
    window = Window.partitionBy(*map(quoted, by)).orderBy(*_ascending(order_by))
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    out = {name: make().over(window) for name, make in ((row_number, F.row_number), (rank, F.rank), (dense_rank, F.dense_rank)) if name}
    out = {name: column.cast("bigint") for name, column in out.items()}  # as counts over stretches are
    out |= {a: F.sum(quoted(c)).over(upto) for a, c in sums.items()}
    out |= {a: F.lag(quoted(c)).over(window) for a, c in lags.items()} | {a: F.lead(quoted(c)).over(window) for a, c in leads.items()}
    return df.select(*map(quoted, df.columns), *[column.alias(a) for a, column in out.items()])


def _ranked(df: DataFrame, by: Sequence[str], order_by: Sequence[str], rank: str | None, dense_rank: str | None, rows: int) -> DataFrame:
    """Ranks from one row per distinct value, put back beside the rows."""
    names = [*dict.fromkeys([*by, *order_by])]
    values = df.groupBy(*map(quoted, names)).agg(F.count(F.lit(1)).alias("__n"))
    placed = running(values, by, order_by, row_number="__dense", sums={"__upto": "__n"}, rows=rows)
    side = placed.select(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("__value"),
                         (F.col("__upto") - F.col("__n") + 1).alias("__rank"), "__dense")
    here = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    joined = df.withColumn("__here", here).join(side, F.col("__here") == F.col("__value"))
    return joined.select(*map(quoted, df.columns), *([F.col("__rank").alias(rank)] if rank else []),
                         *([F.col("__dense").alias(dense_rank)] if dense_rank else []))


# rows of one chunk, and so of one sort, in framed()
_CHUNK = 100_000


def framed(df: DataFrame, by: Sequence[str], order_by: Sequence[str], stretch: Column | str | None, preceding: int,
           following: int, aggregates: Mapping[str, Column], chunk: int = _CHUNK, rows: int = ROWS) -> DataFrame:
    """Aggregates over ``ROWS BETWEEN preceding PRECEDING AND following FOLLOWING`` per ``by`` group.

    Rows are numbered with :func:`running` and cut into chunks of equal size; the
    few rows at a chunk's edge are also sent to its neighbours. No task sorts
    more than a chunk of a group at a time, however large the group is. ``stretch`` and ``rows``
    are those of :func:`running`; None samples the cuts.
    """
    chunk = max(chunk, preceding, following)  # a chunk reaches into its neighbours only
    numbered = running(df, by, order_by, stretch, row_number="__row", rows=rows)
    row = F.col("__row") - 1
    home = F.floor(row / chunk)
    numbered = numbered.withColumn("__home", home).withColumn("__chunk", F.explode(F.array_distinct(F.array(
        F.floor(F.greatest(row - following, F.lit(0)) / chunk), home, F.floor((row + preceding) / chunk)))))
    frame = Window.partitionBy(*map(quoted, by), "__chunk").orderBy("__row").rowsBetween(-preceding, following)
    computed = numbered.select("*", *[a.over(frame).alias(name) for name, a in aggregates.items()])
    return computed.filter("__chunk = __home").select(*map(quoted, df.columns), *map(quoted, aggregates))
