"""Column profiles: one row per column, computed for all columns together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from steplake.operators.steps import quoted, require_columns, sample_rows


def display_type(data_type: T.DataType) -> str:
    """Short type label shown next to a column."""
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "dec"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "ts"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.VariantType, T.StructType, T.MapType, T.ArrayType)):
        return "json"
    return "txt"


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]


def histogram(df: DataFrame, columns: Sequence[str] | str, bins: int = 8) -> DataFrame:
    """Equal-width bins per numeric column: column, bin (1..bins), low, high, count and height 0..1.

    NaN and infinite values have no place between the limits; where a column has some they
    are counted in bin 0, without limits and height. Two passes over the listed columns, whatever their number: one for the
    limits, one that counts every bin of every column.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, names)
    values = df.select(*[quoted(c).cast("double").alias(c) for c in names])
    odd = {c: F.isnan(quoted(c)) | (F.abs(quoted(c)) == float("inf")) for c in names}
    apart = values.agg(*[F.count_if(odd[c]).alias(c) for c in names]) if names else None
    values = values.select(*[F.when(~F.coalesce(odd[c], F.lit(False)), quoted(c)).alias(c) for c in names])
    # one row: the limits of every column
    limits = values.agg(*[f(quoted(c)).alias(f"{c}.{k}") for c in names
                          for k, f in (("low", F.min), ("high", F.max))]).first()
    schema = "column string, bin int, low double, high double, count bigint, height double"
    filled = [c for c in names if limits[f"{c}.low"] is not None]
    left_out = apart.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(0).alias("bin"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
                 quoted(c).alias("count"), F.lit(None).cast("double").alias("height")) for c in names]))).filter("count > 0")
    if not filled:
        return left_out.to(T.StructType.fromDDL(schema))

    def placed(c):
        low, high = F.lit(limits[f"{c}.low"]), F.lit(limits[f"{c}.high"])
        # the maximum falls into bin bins+1, and equal limits give NULL
        place = F.least(F.coalesce(F.width_bucket(quoted(c), low, high, F.lit(bins)), F.lit(1)), F.lit(bins))
        return F.struct(F.lit(c).alias("column"), low.alias("low"), high.alias("high"),
                        F.when(quoted(c).isNotNull(), place).alias("place"))

    numbers = range(1, bins + 1)
    counted = (values.select(F.inline(F.array(*map(placed, filled)))).groupBy("column", "low", "high")
               .agg(F.array(*[F.count_if(F.col("place") == b) for b in numbers]).alias("counts")))
    width = (F.col("high") - F.col("low")) / bins
    spread = counted.select("column", "low", "high", F.array_max("counts").alias("tallest"),
                            F.posexplode("counts").alias("i", "count"))
    return spread.select(
        "column", (F.col("i") + 1).alias("bin"), (F.col("low") + F.col("i") * width).alias("low"),
        F.when(F.col("i") + 1 == bins, F.col("high")).otherwise(F.col("low") + (F.col("i") + 1) * width).alias("high"),
        "count", (F.col("count") / F.col("tallest")).alias("height")).unionByName(left_out).to(T.StructType.fromDDL(schema))


def profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False, bins: int = 8) -> DataFrame:
    """Nulls, distinct values, limits and a small histogram, one row per column.

    One pass finds nulls and limits of all columns; text limits need a sort-based
    aggregate, so distinct values, which are shuffled, are counted in a pass of
    their own by hash. On very large tables ``approx`` replaces the exact
    distinct counts by sketches of fixed size.
    """
    names = list(columns or df.columns)
    require_columns(df, names)
    values = df.select(*[_comparable(quoted(c), df.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(names)])
    total = F.col("total")
    parts = [F.count(F.lit(1)).alias("total")]
    for i in range(len(names)):
        parts += [F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}")]
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                 F.lit(display_type(df.schema[c].dataType)).alias("display_type"),
                 total.alias("total_rows"), (total - F.col(f"n{i}")).alias("null_count"),
                 F.col(f"lo{i}").cast("string").alias("min_value"), F.col(f"hi{i}").cast("string").alias("max_value"))
        for i, c in enumerate(names)])
    limits = values.agg(*parts).select(F.inline(rows))
    if approx:
        different = values.agg(*[F.approx_count_distinct(f"c{i}").alias(f"d{i}") for i in range(len(names))]).select(
            F.posexplode(F.array(*[F.col(f"d{i}") for i in range(len(names))])).alias("position", "distinct_count"))
    else:
        different = distinct_counts(values, values.columns)
    # one row per column on both sides
    result = limits.join(different, "position").withColumn("null_pct", F.when(
        F.col("total_rows") > 0, F.round(F.col("null_count") * 100.0 / F.col("total_rows"), 1).cast("double")
    ).otherwise(0.0))
    numeric = _numeric(df, names)
    if bins and numeric:
        # at most `bins` rows per column
        bars = histogram(df, numeric, bins).filter("bin > 0").groupBy(F.col("column").alias("name")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("bin", "height"))), lambda s: s["height"])
            .alias("histogram"))
        result = result.join(bars, "name", "left")
    else:
        result = result.withColumn("histogram", F.lit(None).cast("array<double>"))
    return result.select("position", "name", "data_type", "display_type", "total_rows", "null_count", "null_pct",
                         "distinct_count", "min_value", "max_value", "histogram")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """position, distinct_count of each column, NULL left out, through one shuffle.

    A value is two independent 64-bit hashes, so that what is shuffled is small and of one type for all columns; map tasks
    send each pair once. Two of ten thousand billion values agree in both with a probability below 10**-12.
    """
    marks = F.array(*[F.struct(F.lit(i).alias("position"), F.xxhash64(quoted(c)).alias("a"), F.xxhash64(F.lit(7), quoted(c)).alias("b"),
                               quoted(c).isNotNull().alias("filled")) for i, c in enumerate(columns)])
    pairs = df.select(F.inline(marks)).filter("filled").groupBy("position", "a", "b").agg(F.lit(1).alias("one"))
    counted = pairs.groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    places = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("position"))
    return places.join(counted, "position", "left").select("position", F.coalesce("n", F.lit(0)).alias("distinct_count"))


def _comparable(column, data_type):
    """Maps and variants have no order; their JSON text has."""
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return F.to_json(column)
    return column


def sampled_profile(df: DataFrame, fraction: float, seed: int = 42, keys: Sequence[str] | None = None, **options) -> DataFrame:
    """Profile of a sample, labelled with the sample's size and the table's size.

    With ``keys`` the rows are picked by the keys' hash, so the sample is the same each time.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = sample_rows(df, keys, fraction, seed) if keys else df.sample(fraction=fraction, seed=seed)
    return (profile(rows, **options)
            .withColumnRenamed("total_rows", "sample_rows").withColumn("table_rows", total))


def suggest_rules(profiled: DataFrame, table_name: str) -> DataFrame:
    """Rules offered from a profile: not_null where some values are missing, unique where all differ."""
    filled = F.col("total_rows") - F.col("null_count")
    offers = F.array(
        F.when(F.col("null_count") > 0, F.struct(
            F.lit("not_null").alias("rule_type"),
            F.concat_ws(" ", F.col("null_pct").cast("string"), F.lit("% null")).alias("reason"))),
        F.when((filled > 0) & (F.col("distinct_count") == filled), F.struct(
            F.lit("unique").alias("rule_type"), F.lit("all values differ").alias("reason"))))
    return (profiled.select(F.col("name").alias("column_name"), F.explode(offers).alias("offer"))
            .filter("offer IS NOT NULL")
            .select(F.concat_ws("-", F.lit("rule"), F.lit(table_name), "offer.rule_type", "column_name").alias("id"),
                    F.lit(table_name).alias("table_name"), "offer.rule_type", "column_name", "offer.reason"))
