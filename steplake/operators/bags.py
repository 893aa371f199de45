"""INTERSECT ALL and EXCEPT ALL by multiplicity: equal rows are counted, never compared one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steplake.operators.steps import quoted

BLOCK = 10_000  # copies of a row that one row of the plan stands for


def _counted(df: DataFrame, name: str) -> DataFrame:
    """One row per distinct row, as a struct, so that NULLs are equal; combined on the map side."""
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return df.groupBy(row.alias("__row")).agg(F.count(F.lit(1)).alias(name))


def _replayed(counts: DataFrame, n: Column, like: DataFrame, block: int) -> DataFrame:
    """``n`` copies of each row. A row with many is first split into blocks, and the blocks are spread over the tasks."""
    blocks = counts.select("__row", n.alias("__n")).filter("__n > 0").withColumn(
        "__at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(block).cast("bigint"))))
    dealt = blocks.select("__row", F.least(F.col("__n") - F.col("__at"), F.lit(block)).alias("__here")).hint("rebalance")
    copies = dealt.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__here").cast("int"))).alias("__copy"))
    return copies.select(*[F.col("__row")[f"c{i}"].alias(c) for i, c in enumerate(like.columns)])


def _checked(left: DataFrame, right: DataFrame) -> DataFrame:
    """The right side by the left one's names and types; columns go by place, as in SQL."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{len(left.columns)} columns on one side, {len(right.columns)} on the other")
    return right.select(*[quoted(b).cast(left.schema[a].dataType).alias(a) for a, b in zip(left.columns, right.columns)])


def intersect_all(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of both sides, each as often as on the side that has fewer. NULL equals NULL."""
    both = _counted(left, "__l").join(_counted(_checked(left, right), "__r"), "__row")
    return _replayed(both, F.least("__l", "__r"), left, block)


def except_all(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of the left side, less one for each equal row of the right side."""
    both = _counted(left, "__l").join(_counted(_checked(left, right), "__r"), "__row", "left")
    return _replayed(both, F.col("__l") - F.coalesce("__r", F.lit(0)), left, block)
