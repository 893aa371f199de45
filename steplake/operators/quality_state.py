"""Quality of a growing table from what each load has added.

A load is judged once. It leaves a few counts per rule and, for ``unique``, the hashes of its distinct values; both add up, so the
results for the whole table never read old rows. A load that is judged again replaces what it left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from steplake.operators.quality import Rule, _failed_rows, _resolves, result_rows
from steplake.operators.steps import quoted
from steplake.sources import storage
from steplake.streaming import streams

_COUNTS = "place int, complaint string, total bigint, failed bigint, filled bigint"
_KEYS = "place int, a bigint, b bigint"


def add_load(df: DataFrame, rules: Sequence[Rule], path: str, load: str | int) -> None:
    """Judge a load and keep its partial results under its name. The same rules have to be given for every load."""
    spark, target = df.sparkSession, f"{path}/load={load}"
    complaints = [_resolves(df, r) for r in rules]
    parts, rows = [F.count(F.lit(1)).alias("total")], []
    unique = [i for i, r in enumerate(rules) if r.rule_type == "unique" and not complaints[i]]
    for i, rule in enumerate(rules):
        # a minimum of rows is judged when the loads are put together
        plain = not complaints[i] and rule.rule_type not in ("unique", "row_count_min")
        failed, filled = (_failed_rows(rule) if plain else F.lit(0)), (F.count(quoted(rule.column_name)) if i in unique else F.lit(0))
        parts += [F.coalesce(failed, F.lit(0)).cast("bigint").alias(f"f{i}"), filled.cast("bigint").alias(f"n{i}")]
        rows.append(F.struct(F.lit(i).alias("place"), F.lit(complaints[i]).cast("string").alias("complaint"), F.col("total"),
                             F.col(f"f{i}").alias("failed"), F.col(f"n{i}").alias("filled")))
    counts = df.agg(*parts).select(F.inline(F.array(*rows))) if rows else df.agg(*parts).select(
        F.lit(-1).alias("place"), F.lit(None).cast("string").alias("complaint"), "total", F.lit(0).cast("bigint").alias("failed"), F.lit(0).cast("bigint").alias("filled"))
    counts.write.mode("overwrite").parquet(f"{target}/counts")
    if unique:
        marks = F.array(*[F.when(quoted(rules[i].column_name).isNotNull(), F.struct(
            F.lit(i).alias("place"), F.xxhash64(quoted(rules[i].column_name)).alias("a"), F.xxhash64(F.lit(7), quoted(rules[i].column_name)).alias("b"))) for i in unique])
        keys = df.select(F.explode(F.array_compact(marks)).alias("m")).select("m.*").distinct()
    else:
        keys = spark.createDataFrame([], _KEYS)
    keys.write.mode("overwrite").parquet(f"{target}/keys")


def loads(spark: SparkSession, path: str) -> list[str]:
    """Names of the loads that were judged to the end."""
    found = [n.split("=", 1)[1] for n, folder, *_ in storage.children(spark, path) if folder and n.startswith("load=")]
    return sorted(n for n in found if storage.exists(spark, f"{path}/load={n}/keys/_SUCCESS"))


def whole_results(spark: SparkSession, rules: Sequence[Rule], path: str, table_name: str = "", chosen: Sequence[str] | None = None) -> DataFrame:
    """What ``evaluate`` gives for all rows of the loads (or of the ``chosen`` ones), from their partial results."""
    names = list(chosen) if chosen is not None else loads(spark, path)
    if not names:
        raise ValueError(f"{path} holds no load")
    counts = spark.read.schema(_COUNTS).parquet(*[f"{path}/load={n}/counts" for n in names])
    sums = counts.groupBy("place").agg(F.max("complaint").alias("complaint"), *[F.sum(c).alias(c) for c in ("total", "failed", "filled")])
    keys = spark.read.schema(_KEYS).parquet(*[f"{path}/load={n}/keys" for n in names])
    different = keys.distinct().groupBy("place").agg(F.count(F.lit(1)).alias("different"))
    # one row per rule from here on
    found = {r["place"]: r for r in sums.join(different, "place", "left").collect()}
    total = next(iter(found.values()))["total"]
    complaints, failed = [], []
    for i, rule in enumerate(rules):
        r = found[i]
        complaints.append(r["complaint"])
        if rule.rule_type == "unique":
            failed.append(r["filled"] - (r["different"] or 0))
        elif rule.rule_type == "row_count_min":
            failed.append(max(int(rule.params.get("min_count", 1)) - total, 0))
        else:
            failed.append(r["failed"])
    wide = spark.range(1).select(F.lit(total).cast("bigint").alias("total"), *[F.lit(n).cast("bigint").alias(f"f{i}") for i, n in enumerate(failed)])
    return result_rows(wide, rules, complaints, table_name)


def breach_history(spark: SparkSession, rules: Sequence[Rule], path: str) -> DataFrame:
    """rule_id, load, failed_rows, total_rows of every load by itself, for a trend; repeats of ``unique`` are those within the load."""
    ids = spark.createDataFrame([(i, r.id, r.rule_type, int(r.params.get("min_count", 1)) if r.rule_type == "row_count_min" else None)
                                 for i, r in enumerate(rules)], "place int, rule_id string, kind string, least bigint")
    name = F.regexp_extract("_metadata.file_path", "/load=([^/]*)/", 1)
    read = lambda schema, part: spark.read.schema(schema).parquet(*[f"{path}/load={n}/{part}" for n in loads(spark, path)])
    counts = read(_COUNTS, "counts").select("*", name.alias("load"))
    keys = read(_KEYS, "keys").select("place", name.alias("load")).groupBy("place", "load").agg(F.count(F.lit(1)).alias("different"))
    joined = counts.join(F.broadcast(ids), "place").join(keys, ["place", "load"], "left")
    failed = (F.when(F.col("kind") == "unique", F.col("filled") - F.coalesce("different", F.lit(0)))
              .when(F.col("kind") == "row_count_min", F.greatest(F.col("least") - F.col("total"), F.lit(0))).otherwise(F.col("failed")))
    return joined.select("rule_id", "load", failed.alias("failed_rows"), F.col("total").alias("total_rows"))


def stream_whole_quality(df: DataFrame, rules: Sequence[Rule], path: str, checkpoint: str, once: bool = True):
    """Judge every micro-batch as a load, so that :func:`whole_results` tells at any time how good all rows so far are."""
    def judge(rows: DataFrame, batch_id: int) -> None:
        add_load(rows, rules, path, batch_id)
    return streams.each_batch(df, judge, checkpoint, once)
