"""The nine step kinds. Each is a function from a DataFrame to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from steplake.functions.casts import resolve_type, soft_cast

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}


def quoted(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {', '.join(missing)}; have: {', '.join(df.columns)}")


def sort_keys(columns: Sequence[str | dict], reverse: bool = False) -> list[Column]:
    """Sort columns from names or ``{"column", "ascending"}``; NULLs last in both directions.

    ``reverse`` gives the exact mirror image, so the last row of the order becomes the first.
    """
    keys = []
    for item in columns:
        name, ascending = (item, True) if isinstance(item, str) else (
            item["column"], item.get("ascending", True))
        column = quoted(name)
        if reverse:
            keys.append(column.desc_nulls_first() if ascending else column.asc_nulls_first())
        else:
            keys.append(column.asc_nulls_last() if ascending else column.desc_nulls_last())
    return keys


def filter_rows(df: DataFrame, condition: str | None = None, column: str | None = None,
                operator: str = "==", value: Any = None) -> DataFrame:
    """Keep the rows where the condition is true. A condition wins over column/operator/value."""
    if condition:
        return df.filter(F.expr(condition))
    if not column:
        return df
    if operator not in _COMPARE:
        raise ValueError(f"unknown operator {operator!r}; use one of {', '.join(_COMPARE)}")
    require_columns(df, [column])
    return df.filter(_COMPARE[operator](quoted(column), F.lit(value)))


def drop_null(df: DataFrame, columns: Sequence[str] = (), column: str | None = None) -> DataFrame:
    """Drop rows with a NULL in any listed column, or in any column when none is listed."""
    names = list(columns) or ([column] if column else df.columns)
    require_columns(df, names)
    for name in names:
        df = df.filter(quoted(name).isNotNull())
    return df


def deduplicate(df: DataFrame, columns: Sequence[str] = (), keep: str = "first",
                order_by: Sequence[str | dict] | None = None) -> DataFrame:
    """One row per key, the first or last in ``order_by``; without keys, distinct rows.

    Spark applies ``row_number() = 1`` before the shuffle as well as after it
    (WindowGroupLimit), so a key that holds a third of all rows sends one row per
    map task instead of the whole group.
    """
    if not columns:
        return df.distinct()
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    if not order_by:
        raise ValueError("deduplicate by key needs order_by: rows have no order of their own")
    require_columns(df, columns)
    window = Window.partitionBy(*map(quoted, columns)).orderBy(*sort_keys(order_by, keep == "last"))
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)


def derive(df: DataFrame, column_name: str = "kolom_baru", expression: str = "NULL") -> DataFrame:
    """Append a column computed by any SQL expression."""
    return df.withColumn(column_name, F.expr(expression))


def aggregate(df: DataFrame, group_by: Sequence[str] = (), aggregations: Sequence[dict] = (),
              order_by: Sequence[str] | None = None) -> DataFrame:
    """Group and aggregate. ``first``/``last`` follow ``order_by``; other names go to Spark SQL."""
    require_columns(df, group_by)
    keys = [quoted(c) for c in group_by]
    if not aggregations:
        if not keys:
            raise ValueError("aggregate needs group_by or aggregations")
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[_aggregation(df, spec, order_by) for spec in aggregations])


def _aggregation(df: DataFrame, spec: dict, order_by: Sequence[str] | None) -> Column:
    function = spec.get("function", "COUNT").lower()
    name = spec.get("column") or "*"
    alias = spec.get("alias") or f"{function}_{name}"
    if name == "*":
        return F.call_function(function, F.lit(1)).alias(alias)
    require_columns(df, [name])
    if function in ("first", "last"):
        if not order_by:
            raise ValueError(f"{function} needs order_by: rows have no order of their own")
        # the flag in front of each key puts NULLs last, as in sort
        rank = F.struct(*[part for key in order_by
                          for part in (quoted(key).isNull(), quoted(key))])
        pick = F.min_by if function == "first" else F.max_by
        return pick(quoted(name), rank).alias(alias)
    return F.call_function(function, quoted(name)).alias(alias)


def rename(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename columns in place."""
    mapping = mapping or {}
    require_columns(df, list(mapping))
    return df.withColumnsRenamed(mapping)


def cast_columns(df: DataFrame, casts: dict[str, str] | None = None, strict: bool = False,
                 date_format: str | None = None) -> DataFrame:
    """Change column types in place. Bad values become NULL, or fail the job when strict."""
    casts = casts or {}
    require_columns(df, list(casts))
    changed = {}
    for name, alias in casts.items():
        target = resolve_type(alias)
        if strict:
            changed[name] = quoted(name).cast(target)
        else:
            changed[name] = soft_cast(quoted(name), df.schema[name].dataType, target, date_format)
    return df.withColumns(changed) if changed else df


def sort_rows(df: DataFrame, columns: Sequence[str | dict] = ()) -> DataFrame:
    """Order by several keys, NULLs last in both directions."""
    return df.orderBy(*sort_keys(columns)) if columns else df


def limit_rows(df: DataFrame, n: int = 100, offset: int = 0) -> DataFrame:
    """A page of rows in the running order."""
    return df.offset(offset).limit(n) if offset else df.limit(n)


STEPS: dict[str, Callable[..., DataFrame]] = {
    "filter": filter_rows,
    "drop_null": drop_null,
    "deduplicate": deduplicate,
    "derive": derive,
    "aggregate": aggregate,
    "rename": rename,
    "cast": cast_columns,
    "sort": sort_rows,
    "limit": limit_rows,
}


def sample_rows(df: DataFrame, keys: Sequence[str], fraction: float, seed: int | str = 42) -> DataFrame:
    """A sample that depends on the keys only: the rows whose hash lies below ``fraction`` of all hashes.

    The same rows are picked again however the table is stored, and rows with equal keys go together.
    """
    require_columns(df, keys)
    if not 0 <= fraction <= 1:
        raise ValueError("fraction lies between 0 and 1")
    if fraction == 1:
        return df
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[quoted(k).cast("string") for k in keys]))
    return df.filter(F.substring(digest, 1, 8) < F.lit(f"{int(fraction * 2 ** 32):08x}"))
