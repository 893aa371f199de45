"""Column profiles that add up: a table of small sketches per partition, merged for any part of a table.

A row holds, for one partition, its number of rows and for each column the filled rows, limits, a HyperLogLog sketch of
its values and, for numbers, a KLL sketch of their distribution. Sketches of parts merge into the sketch of the
whole, so profiling a table after a day of loads reads that day only.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from steplake.operators.profile import _comparable, display_type
from steplake.operators.steps import quoted, require_columns
from steplake.sources import storage

HLL_BITS = 14  # 2**14 registers: counts are off by about 0.8 percent, small ones are exact
KLL_SIZE = 400  # ranks are off by less than 0.7 percent with 99 percent certainty
_POINTS = 400  # quantiles a histogram is made from
_LISTED_PARTITIONS = 200  # more changed partitions than this are joined instead of named in the filter
_GENERATION = "generation"


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _parts(name: str, kind: T.DataType) -> Column:
    c = _comparable(quoted(name), kind)
    hashed = F.xxhash64(c)  # any type; equal values only are equal
    number = c.cast("double") if _is_number(kind) else None
    finite = F.when(F.abs(number) < float("inf"), number) if number is not None else None
    return F.struct(F.count(c).alias("filled"), F.min(c).alias("low"), F.max(c).alias("high"),
                    F.hll_sketch_agg(F.when(c.isNotNull(), hashed), F.lit(HLL_BITS)).alias("values"),
                    *([F.kll_sketch_agg_double(finite, F.lit(KLL_SIZE)).alias("shape"), F.count(finite).alias("finite")] if number is not None else []))


def sketch(df: DataFrame, partition_by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One row per partition: its columns, ``rows``, and a struct per profiled column. Map tasks send sketches, never rows."""
    names = [c for c in (columns or df.columns) if c not in partition_by]
    require_columns(df, [*names, *partition_by])
    return df.groupBy(*map(quoted, partition_by)).agg(F.count(F.lit(1)).alias("rows"), *[_parts(c, df.schema[c].dataType).alias(c) for c in names])


def merge_sketches(sketches: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Sketches of parts as sketches of what they make up, per ``partition_by`` or of everything."""
    def merged(f: T.StructField) -> Column:
        at = lambda c: F.col(f"`{f.name}`.`{c}`")
        has = {x.name for x in f.dataType}
        return F.struct(F.sum(at("filled")).alias("filled"), F.min(at("low")).alias("low"), F.max(at("high")).alias("high"),
                        F.hll_union_agg(at("values")).alias("values"),
                        *([F.kll_merge_agg_double(at("shape")).alias("shape"), F.sum(at("finite")).alias("finite")] if "shape" in has else [])).alias(f.name)
    return sketches.groupBy(*map(quoted, partition_by)).agg(F.sum("rows").alias("rows"), *[merged(f) for f in _sketched(sketches)])


def _sketched(sketches: DataFrame) -> list[T.StructField]:
    return [f for f in sketches.schema if isinstance(f.dataType, T.StructType) and {"filled", "values"} <= {x.name for x in f.dataType}]


def sketched_profile(sketches: DataFrame, bins: int = 8) -> DataFrame:
    """A row per column from the sketches of any partitions, in the shape of ``profile``, with quartiles.

    Rows, nulls and limits are exact, ``distinct_count`` and the quartiles have the sketches' error, and a bin's
    height counts the quantiles that lie in it.
    """
    whole = merge_sketches(sketches)

    def row(i: int, f: T.StructField) -> Column:
        at = lambda c: F.col(f"`{f.name}`.`{c}`")
        kind = f.dataType["low"].dataType
        filled = F.coalesce(at("filled"), F.lit(0))
        nothing = F.lit(None).cast("double")
        quartiles, heights = [nothing] * 3, F.lit(None).cast("array<double>")
        if "shape" in f.dataType.names:
            some = F.coalesce(at("finite"), F.lit(0)) > 0
            quartiles = [F.when(some, F.kll_sketch_get_quantile_double(at("shape"), F.lit(q))) for q in (0.25, 0.5, 0.75)]
            points = F.kll_sketch_get_quantile_double(at("shape"), F.array(*[F.lit(i / _POINTS) for i in range(_POINTS + 1)]))
            low, high = F.element_at(points, 1), F.element_at(points, -1)
            upto = lambda b: F.size(F.filter(points, lambda x: x <= low + (high - low) * b / bins)) / (_POINTS + 1)
            share = [(F.lit(1.0) if b == bins else upto(b)) - (F.lit(0.0) if b == 1 else upto(b - 1)) for b in range(1, bins + 1)]
            # one value fills the first bin
            made = F.when(low < high, F.array(*share)).otherwise(F.array(F.lit(1.0), *[F.lit(0.0)] * (bins - 1)))
            heights = F.when(some, F.transform(made, lambda s: s / F.array_max(made)))
        rows = F.coalesce("rows", F.lit(0))
        return F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(kind.simpleString()).alias("data_type"),
            F.lit(display_type(kind)).alias("display_type"), rows.alias("total_rows"), (rows - filled).alias("null_count"),
            F.when(rows > 0, F.round((rows - filled) * 100.0 / rows, 1).cast("double")).otherwise(0.0).alias("null_pct"),
            F.when(filled > 0, F.hll_sketch_estimate(at("values"))).otherwise(0).alias("distinct_count"),
            at("low").cast("string").alias("min_value"), at("high").cast("string").alias("max_value"),
            *[q.alias(n) for q, n in zip(quartiles, ("q25", "q50", "q75"))], heights.alias("histogram"))
    return whole.select(F.inline(F.array(*[row(i, f) for i, f in enumerate(_sketched(sketches))])))


# ---- kept beside a partitioned table

def _signatures(table: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """A number per partition that changes with its files; no column is read."""
    of = [F.col(f"_metadata.{c}").alias(f"__{c}") for c in ("file_path", "file_size", "file_modification_time")]
    files = table.select(*map(quoted, partition_by), *of).groupBy(*map(quoted, partition_by), "__file_path", "__file_size", "__file_modification_time").count()
    return files.groupBy(*map(quoted, partition_by)).agg(
        F.bit_xor(F.xxhash64("__file_path", "__file_size", "__file_modification_time")).alias("signature"))


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished generations, in order."""
    found = [int(name.split("=", 1)[1]) for name, folder, *_ in storage.children(spark, path) if folder and name.startswith(f"{_GENERATION}=")]
    return sorted(n for n in found if storage.exists(spark, f"{path}/{_GENERATION}={n}/_SUCCESS"))


def read_sketches(spark: SparkSession, path: str) -> DataFrame | None:
    """The kept sketches, one row per partition; None if there are none yet."""
    known = _generations(spark, path)
    return spark.read.parquet(f"{path}/{_GENERATION}={known[-1]}") if known else None


def _matching(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Semi and anti joins on columns where NULL equals NULL."""
    side = right.select(*[quoted(c).alias(f"__m{i}") for i, c in enumerate(names)])
    same = functools.reduce(Column.__and__, [quoted(c).eqNullSafe(F.col(f"__m{i}")) for i, c in enumerate(names)])
    return left.join(side, same, how)


def refresh_sketches(table: DataFrame, path: str, partition_by: Sequence[str], columns: Sequence[str] | None = None) -> int:
    """Bring the kept sketches of a partitioned table of files up to date; returns how many partitions were read.

    A partition is read again if its files, their sizes or times differ from those it was sketched with; sketches of partitions
    that are gone are dropped. The new generation is complete before the old one goes, so a failure leaves the old one.
    """
    if not partition_by:
        raise ValueError("sketches are kept per partition")
    spark, names = table.sparkSession, list(partition_by)
    now, old = _signatures(table, names), read_sketches(spark, path)
    changed = now if old is None else _matching(now, old.select(*map(quoted, names), "signature"), [*names, "signature"], "left_anti")
    number = (_generations(spark, path) or [0])[-1] + 1
    target = f"{path}/{_GENERATION}={number}"
    changed.write.mode("overwrite").parquet(f"{path}/changed")
    changed = spark.read.schema(changed.schema).parquet(f"{path}/changed")
    listed = changed.limit(_LISTED_PARTITIONS + 1).collect()
    if len(listed) <= _LISTED_PARTITIONS:
        # named in the filter, so that other partitions' files are not even listed
        wanted = [functools.reduce(Column.__and__, [quoted(c).eqNullSafe(F.lit(r[c])) for c in names]) for r in listed]
        rows = table.filter(functools.reduce(Column.__or__, wanted, F.lit(False)))
    else:
        rows = _matching(table, changed, names, "left_semi")
    side = changed.select(*[quoted(c).alias(f"__m{i}") for i, c in enumerate(names)], "signature")
    same = functools.reduce(Column.__and__, [quoted(c).eqNullSafe(F.col(f"__m{i}")) for i, c in enumerate(names)])
    made = sketch(rows, names, columns).join(side, same).drop(*[f"__m{i}" for i in range(len(names))])
    if old is not None:
        stays = _matching(_matching(old, changed, names, "left_anti"), now, names, "left_semi")
        made = stays.select(*map(quoted, made.columns)).unionByName(made)
    made.write.mode("overwrite").parquet(target)
    n_changed = len(listed) if len(listed) <= _LISTED_PARTITIONS else changed.count()
    for gone in _generations(spark, path)[:-1]:
        storage.remove(spark, f"{path}/{_GENERATION}={gone}")
    storage.remove(spark, f"{path}/changed")
    return n_changed
