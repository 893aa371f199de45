"""Stretches of equal depth: a group of any size, cut along its order at sampled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from steplake.operators.steps import quoted
from steplake.session import ensure_checkpoint_dir

ROWS = 1_000_000  # a stretch's rows, on average; a table with no more is not cut at all
SAMPLED = 32  # sampled rows of a stretch, so twice ROWS is more than five deviations away
_BROADCAST_CUTS = 100_000  # more cuts than this meet the rows in an ordinary join
_SEED = 1729


def nulls_last(columns: Sequence[Column]) -> list[Column]:
    """Values that compare as ``ORDER BY ... NULLS LAST`` does."""
    return [part for c in columns for part in (c.isNull(), c)]


def tie_breaker(df: DataFrame) -> Column:
    """Parts rows that agree in the order but not in all columns; columns without a hash do not help."""
    return F.xxhash64(*[quoted(f.name) for f in df.schema if _hashable(f.dataType)])


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def place_among(cuts: Column, at: Column) -> Column:
    """How many of the ascending cuts are not behind ``at``, by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1.0)).cast("int") + 1)
    half = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    return F.aggregate(steps, pair(F.lit(0), F.size(cuts)), lambda s, _: F.when(s["lo"] >= s["hi"], s).when(
        F.get(cuts, half(s)) <= at, pair(half(s) + 1, s["hi"])).otherwise(pair(s["lo"], half(s))), lambda s: s["lo"])


def _key(by: Sequence[Column]) -> Column:
    return F.struct(F.lit(0).alias("k"), *[c.alias(f"k{i}") for i, c in enumerate(by)])


def sampled_cuts(df: DataFrame, by: Sequence[Column], order: Column, rows: int, total: int | None = None) -> DataFrame | None:
    """(__of, __cuts): every SAMPLED-th of a group's sampled rows in order; None for a table of no more than ``rows`` rows."""
    if (df.count() if total is None else total) <= rows:
        return None
    sampled = df.select(_key(by).alias("__of"), order.alias("__cut")).sample(fraction=min(1.0, SAMPLED / rows), seed=_SEED)
    place = F.row_number().over(Window.partitionBy("__of").orderBy("__cut"))
    cuts = (sampled.withColumn("__place", place).filter(F.col("__place") % SAMPLED == 0)
            .groupBy("__of").agg(F.sort_array(F.collect_list("__cut")).alias("__cuts")))
    # a sample may come out differently when it is drawn again, so its cuts are kept
    ensure_checkpoint_dir(df.sparkSession)
    return cuts.checkpoint()


def beside_cuts(df: DataFrame, cuts: DataFrame, by: Sequence[Column]) -> DataFrame:
    """The rows with the cuts of their group, NULL for a group without."""
    if not by:  # one group, so one row of cuts
        return df.withColumn("__cuts", cuts.select("__cuts").scalar())
    few = (cuts.agg(F.sum(F.size("__cuts"))).first()[0] or 0) <= _BROADCAST_CUTS
    keyed = df.withColumn("__key", _key(by))
    return keyed.join(F.broadcast(cuts) if few else cuts, F.col("__key") == F.col("__of"), "left").drop("__key", "__of")


def numbered_by(df: DataFrame, numbers: DataFrame, by: Sequence[Column]) -> DataFrame:
    """The rows with the number of their group, NULL for a group without; ``numbers`` has a row for each of few groups."""
    keyed = df.withColumn("__key", _key(by))
    return keyed.join(F.broadcast(numbers), F.col("__key") == F.col("__of"), "left").drop("__key", "__of")


def with_stretch(df: DataFrame, by: Sequence[Column], order: Column, name: str, rows: int = ROWS, total: int | None = None) -> DataFrame:
    """The rows with the number of their stretch within the ``by`` group; the number never falls as ``order``, a struct, rises.

    A stretch holds about ``rows`` rows whatever the values' distribution: a busy key is cut often, one with few rows not
    at all, and a burst is cut wherever the order tells its rows apart. Cuts are computed once and kept. An equal order is never parted.
    """
    cuts = sampled_cuts(df, by, order, rows, total)
    if cuts is None:
        return df.withColumn(name, F.lit(0))
    joined = beside_cuts(df.withColumn("__order", order), cuts, by)
    number = F.when(F.col("__cuts").isNull(), 0).otherwise(place_among(F.col("__cuts"), F.col("__order")))
    return joined.withColumn(name, number).drop("__order", "__cuts")
