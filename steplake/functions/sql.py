"""Free SQL over the session's tables."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

RESULT_LIMIT = 1000


def run_sql(spark: SparkSession, sql: str, limit: int | None = None, **frames: DataFrame) -> DataFrame:
    """Any Spark SQL text; ``{name}`` stands for the DataFrame passed under that name.

    The result is whole; a limit is for rows shown to a person.
    """
    if not sql or not sql.strip():
        raise ValueError("the SQL text is empty")
    result = spark.sql(sql, **frames)
    return result if limit is None else result.limit(limit)


def query_result(spark: SparkSession, sql: str, limit: int = RESULT_LIMIT, **frames: DataFrame) -> dict[str, Any]:
    """The first rows of a query with column names, types and the time it took."""
    started = time.monotonic()
    result = run_sql(spark, sql, limit, **frames)
    rows = [list(row) for row in result.collect()]
    return {"columns": result.columns, "types": [t for _, t in result.dtypes], "rows": rows,
            "row_count": len(rows), "elapsed_ms": round((time.monotonic() - started) * 1000, 2)}
