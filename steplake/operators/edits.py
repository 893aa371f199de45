"""Apply a batch of cell edits, as queued in a grid, to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from steplake.operators.steps import quoted, require_columns


def batch_edit(df: DataFrame, edits: DataFrame, id_col: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Set cells by row id. ``edits`` has ``id, column, new_value, seq``; the highest seq wins.

    The edits become one row per id before the join, so the table is shuffled at
    most once, and not at all when Spark sees that the edits are small. A NULL
    ``new_value`` sets the cell to NULL; a value that does not fit its column fails.
    """
    require_columns(df, [id_col])
    targets = [c for c in (columns or df.columns) if c != id_col]
    require_columns(df, targets)

    def last_edit(name):
        hit = F.col("column") == name
        # wrapped, so that "set to NULL" differs from "not edited"
        return F.max_by(F.when(hit, F.struct("new_value")), F.when(hit, F.col("seq"))).alias(f"__{name}")

    wanted = edits.filter(F.col("column").isin(targets))
    per_row = wanted.groupBy(F.col("id").alias("__id")).agg(*map(last_edit, targets))
    joined = df.join(per_row, quoted(id_col) == F.col("__id"), "left")
    return joined.select(*[
        quoted(c) if c not in targets else
        F.when(quoted(f"__{c}").isNotNull(), quoted(f"__{c}")["new_value"].cast(df.schema[c].dataType))
        .otherwise(quoted(c)).alias(c)
        for c in df.columns])
