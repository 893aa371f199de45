"""Forgiving casts: a value that does not fit becomes NULL, numbers round instead of truncating."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The type names a cast step accepts, and the Spark type each one means.
TYPE_ALIASES = {
    "int": "int",
    "integer": "int",
    "bigint": "bigint",
    "float": "double",
    "double": "double",
    "decimal": "decimal(18,3)",
    "str": "string",
    "varchar": "string",
    "text": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
    "timestamp": "timestamp_ntz",
}

_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
_DATE_LIKE = r"^\s*\d{4,}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}.*)?\s*$"


def resolve_type(name: str) -> str:
    """Spark type for an alias; any other name is passed to Spark as it is."""
    return TYPE_ALIASES.get(name.strip().lower(), name.strip().lower())


def soft_cast(column: Column, source: T.DataType, target: str, date_format: str | None = None) -> Column:
    """Cast that yields NULL for a bad value and rounds where a fraction is lost."""
    if target in _INTEGRAL:
        if isinstance(source, T.StringType):
            # by way of a decimal: a direct try_cast raises and catches an exception per bad value
            return F.round(column.try_cast("decimal(38,10)")).try_cast(target)
        if isinstance(source, (T.FloatType, T.DoubleType)):
            return F.bround(column).try_cast(target)
        if isinstance(source, T.DecimalType):
            return F.round(column).try_cast(target)
    if isinstance(source, T.StringType):
        if target in ("date", "timestamp_ntz"):
            return _text_to_time(column, target, date_format)
        if target in ("float", "double"):
            # Java also reads "1.5d"; a data file that says that does not hold a number
            return F.when(~column.rlike(r"[\d.][dDfF]\s*$"), column).try_cast(target)
        if target == "boolean":
            return F.when(column == F.trim(column), column).try_cast(target)
    return column.try_cast(target)


def _text_to_time(column: Column, target: str, date_format: str | None) -> Column:
    if date_format:
        parsed = F.try_to_timestamp(column, F.lit(date_format)).cast("timestamp_ntz")
    else:
        dashed = F.regexp_replace(column, r"^(\s*\d{4,})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
        # without the pattern "2024" alone would become 2024-01-01
        parsed = F.when(dashed.rlike(_DATE_LIKE), dashed).try_cast("timestamp_ntz")
    return parsed.cast(target)
