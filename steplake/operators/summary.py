"""Summary statistics: ratio to the mean, exact quantiles of groups of any size, describe."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from steplake.operators.steps import quoted, require_columns
from steplake.session import ensure_checkpoint_dir

# The sketch that brackets a quantile is off by at most 1/_ACCURACY of a group's rows ...
_ACCURACY = 10_000
# ... so this margin on either side holds the wanted rank.
_MARGIN = 5 / _ACCURACY
# Brackets with more rows than this are narrowed before their values are sorted.
_SORTED_ROWS = 1_000_000
# A narrowing cuts a bracket into this many parts of equal size and keeps a few.
_PARTS = 100
# Brackets of so many groups are a few megabytes.
_BROADCAST_GROUPS = 5000


def ratio_to_mean(df: DataFrame, column: str, alias: str = "ratio", digits: int = 2) -> DataFrame:
    """Each value divided by the mean of its column, as a scalar subquery."""
    require_columns(df, [column])
    mean = df.agg(F.avg(quoted(column))).scalar()
    return df.withColumn(alias, F.round(quoted(column) / mean, digits))


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float],
              group_by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles: one row per group and probability. NULL and NaN do not count.

    Spark's ``percentile`` keeps every distinct value of a group in one task.
    Here a sketch brackets each quantile by two values and a pass over the table
    counts the rows below and inside. A bracket with many rows is narrowed by a sketch of
    the rows inside, as often as needed, whatever the values' distribution; then the few
    distinct values left in it are sorted. All passes combine on the map side. A bracket
    that misses its rank is widened to the whole group and narrowed again.
    """
    found, _ = _quantiles(df, [value], probabilities, group_by)
    return found.drop("measure")


def _quantiles(df: DataFrame, values: Sequence[str], probabilities: Sequence[float], group_by: Sequence[str],
               extra: Sequence = ()) -> tuple[DataFrame, DataFrame]:
    """Quantiles of several columns at once (group, measure, probability, quantile), and one row per group with
    ``total, least, most`` and the extra aggregates of each column, numbered by its place."""
    require_columns(df, [*values, *group_by])
    keys = [f"__g{i}" for i in range(len(group_by))] or ["__g0"]
    named = [quoted(c).alias(k) for c, k in zip(group_by, keys)] or [F.lit(0).alias("__g0")]
    numbers = [quoted(c).cast("double") for c in values]
    base = df.select(*named, *[F.when(~F.isnan(n), n).alias(f"v{m}") for m, n in enumerate(numbers)])
    spots = [(m, i, p) for m in range(len(values)) for i, p in enumerate(probabilities)]

    edges = [max(p - _MARGIN, 0.0) for p in probabilities] + [min(p + _MARGIN, 1.0) for p in probabilities]
    parts = []
    for m in range(len(values)):
        v = F.col(f"v{m}")
        parts += [F.percentile_approx(v, edges, _ACCURACY).alias(f"e{m}"), F.count(v).alias(f"total{m}"), F.min(v).alias(f"least{m}"),
                  F.max(v).alias(f"most{m}"), *[make(v).alias(f"{name}{m}") for name, make in extra]]
    sketch = base.groupBy(*keys).agg(*parts)
    known = [c for c in sketch.columns if not c.startswith("e") and c not in keys]
    brackets = sketch.select(*keys, *known, *[c for m, i, p in spots for c in (
        (F.col(f"least{m}") if p <= _MARGIN else F.col(f"e{m}")[i]).alias(f"low{m}_{i}"),
        (F.col(f"most{m}") if p >= 1 - _MARGIN else F.col(f"e{m}")[len(probabilities) + i]).alias(f"high{m}_{i}"))])
    # A sketch may come out differently when it is computed again, so it is kept.
    ensure_checkpoint_dir(df.sparkSession)
    brackets = brackets.checkpoint()
    few = brackets.count() <= _BROADCAST_GROUPS
    summary = brackets.select(*[F.col(k).alias(c) for c, k in zip(group_by, keys)], *known)

    left = float("inf")
    while True:
        counted = _counted(base, keys, brackets, spots, few)
        # per bracket: missed, too large, or ready
        states = counted.select(F.inline(F.array(*[F.struct(
            _missed(m, i, p).alias("missed"), F.when(_crowded(m, i), F.col(f"inside{m}_{i}")).alias("inside")) for m, i, p in spots])))
        worst = states.agg(F.max("missed"), F.coalesce(F.max("inside"), F.lit(0))).first()
        # where one value has nearly all rows a bracket may not get smaller; its other values are sorted then
        if not worst[0] and (not worst[1] or worst[1] > 0.9 * left):
            break
        left = worst[1] or left
        brackets = _narrowed(base, keys, counted, spots, few).checkpoint()

    inside = [F.col(f"v{m}").between(F.col(f"low{m}_{i}"), F.col(f"high{m}_{i}")) for m, i, _ in spots]
    rows = _beside(base, keys, brackets, spots, few).filter(functools.reduce(Column.__or__, inside)).select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.when(at, F.col(f"v{m}")).alias("v")) for (m, i, _), at in zip(spots, inside)])))
    distinct = rows.filter("v IS NOT NULL").groupBy(*keys, "m", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys, "m", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn("upto", F.sum("n").over(order))
    wanted = counted.select(*keys, F.inline(F.array(*[F.struct(
        F.lit(m).alias("m"), F.lit(i).alias("i"), F.lit(p).alias("p"), _position(m, p).alias("position"), F.col(f"below{m}_{i}").alias("below"))
        for m, i, p in spots])))
    hit = _null_safe(ranked, wanted, [*keys, "m", "i"], "inner")
    first, last = F.col("below") + F.col("upto") - F.col("n"), F.col("below") + F.col("upto") - 1
    # the value at a rank is the one whose first and last rank hold it
    low = F.max(F.when((F.floor("position") >= first) & (F.floor("position") <= last), F.col("v")))
    high = F.max(F.when((F.ceil("position") >= first) & (F.ceil("position") <= last), F.col("v")))
    fraction = F.max("position") - F.floor(F.max("position"))
    # low + 0 * (inf - inf) would be NaN
    result = F.when(low == high, low).otherwise(low + (high - low) * fraction)
    out = hit.groupBy(*keys, "m", "p").agg(result.alias("quantile")).select(
        *[F.col(k).alias(c) for c, k in zip(group_by, keys)], F.col("m").alias("measure"), F.col("p").alias("probability"), "quantile")
    return out, summary


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where NULL equals NULL; the keys appear once, from the left."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    joined = left.join(renamed, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def _position(m: int, p: float) -> Column:
    """Where the quantile lies among the ranks 0 .. total - 1."""
    return (F.col(f"total{m}") - 1) * F.lit(p)


def _beside(base: DataFrame, keys: Sequence[str], brackets: DataFrame, spots, few: bool) -> DataFrame:
    """Each value beside the brackets of its group."""
    side = brackets.select(*keys, *[F.col(f"{e}{m}_{i}") for m, i, _ in spots for e in ("low", "high")])
    return _null_safe(base, F.broadcast(side) if few else side, keys, "inner")


def _counted(base: DataFrame, keys: Sequence[str], brackets: DataFrame, spots, few: bool) -> DataFrame:
    """The brackets with the rows below and inside each."""
    counts = _beside(base, keys, brackets, spots, few).groupBy(*keys).agg(*[c for m, i, _ in spots for c in (
        F.count_if(F.col(f"v{m}") < F.col(f"low{m}_{i}")).alias(f"below{m}_{i}"),
        F.count_if(_inside(m, i)).alias(f"inside{m}_{i}"))])
    return _null_safe(brackets, counts, keys, "inner").checkpoint()


def _missed(m: int, i: int, p: float) -> Column:
    below, inside = F.col(f"below{m}_{i}"), F.col(f"inside{m}_{i}")
    out = (F.floor(_position(m, p)) < below) | (F.ceil(_position(m, p)) >= below + inside)
    return F.coalesce((F.col(f"total{m}") > 0) & out, F.lit(False))


def _inside(m: int, i: int) -> Column:
    return F.col(f"v{m}").between(F.col(f"low{m}_{i}"), F.col(f"high{m}_{i}"))


def _crowded(m: int, i: int) -> Column:
    """Many rows and more than one value."""
    return F.coalesce((F.col(f"inside{m}_{i}") > _SORTED_ROWS) & (F.col(f"low{m}_{i}") < F.col(f"high{m}_{i}")), F.lit(False))


def _narrowed(base: DataFrame, keys: Sequence[str], counted: DataFrame, spots, few: bool) -> DataFrame:
    """Smaller brackets where there are many rows, whole groups where the rank was missed."""
    shares = [j / _PARTS for j in range(_PARTS + 1)]
    sketched = _beside(base, keys, counted, spots, few).groupBy(*keys).agg(*[F.percentile_approx(
        F.when(F.col(f"v{m}").between(F.col(f"low{m}_{i}"), F.col(f"high{m}_{i}")), F.col(f"v{m}")), shares, _ACCURACY).alias(f"s{m}_{i}")
        for m, i, _ in spots])
    both = _null_safe(counted, sketched, keys, "inner")
    limits = []
    for m, i, p in spots:
        low, high, cuts = F.col(f"low{m}_{i}"), F.col(f"high{m}_{i}"), F.col(f"s{m}_{i}")
        share = (_position(m, p) - F.col(f"below{m}_{i}")) / F.col(f"inside{m}_{i}") * _PARTS
        # one part more on either side than the sketch's error asks for
        left, right = F.greatest(F.floor(share) - 1, F.lit(0)).cast("int"), F.least(F.ceil(share) + 1, F.lit(_PARTS)).cast("int")
        missed, crowded = _missed(m, i, p), _crowded(m, i)
        limits += [F.when(missed, F.col(f"least{m}")).when(crowded & (left > 0), cuts[left]).otherwise(low).alias(f"low{m}_{i}"),
                   F.when(missed, F.col(f"most{m}")).when(crowded & (right < _PARTS), cuts[right]).otherwise(high).alias(f"high{m}_{i}")]
    kept = [c for c in counted.columns if not c.startswith(("low", "high", "below", "inside"))]
    return both.select(*kept, *limits)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum of numeric columns."""
    names = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])
    require_columns(df, names)
    shown = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    points, moments = _quantiles(df, names, list(shown), (), [("mean", F.avg), ("std", F.stddev_samp)])
    # one row per column from here on
    listed = moments.select(F.inline(F.array(*[F.struct(
        F.lit(m).alias("measure"), F.lit(c).alias("column"), F.col(f"total{m}").alias("count"), F.col(f"mean{m}").alias("mean"),
        F.col(f"std{m}").alias("std"), F.col(f"least{m}").alias("min"), F.col(f"most{m}").alias("max")) for m, c in enumerate(names)])))
    quartiles = points.groupBy("measure").agg(*[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for p, name in shown.items()])
    made = listed.join(quartiles, "measure", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return every.join(made, "column", "left").withColumn("count", F.coalesce("count", F.lit(0)))
