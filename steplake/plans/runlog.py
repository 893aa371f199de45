"""Questions about a log of runs: what failed, what is late, what is stale, what took long.

A run log has ``id, target_id, target_name, status, started_at, finished_at,
duration_sec, rows_processed, attempt, step_timelines, logs``; functions only ask
for the columns they use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The fields of a run record.
RUN = """id string, schedule_id string, target_type string, target_id string, target_name string, trigger string,
status string, write_mode string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_sec int,
rows_processed bigint, error_message string,
step_timelines array<struct<step_id: string, step_name: string, status: string, duration_sec: double,
                            rows_in: bigint, rows_out: bigint, error_message: string>>,
logs array<struct<timestamp: string, level: string, message: string>>,
parameters map<string, string>, pipeline_version int, attempt int"""


def _moment(now) -> Column:
    return F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now


def list_runs(runs: DataFrame, status: str | None = None, target: str | None = None, limit: int = 50) -> DataFrame:
    """Newest runs first; ``status`` 'all' or None means any, ``target`` is part of the name in any case."""
    if status and status != "all":
        runs = runs.filter(F.col("status") == status)
    if target:
        runs = runs.filter(F.contains(F.lower("target_name"), F.lower(F.lit(target))))
    return runs.orderBy(F.col("started_at").desc_nulls_last(), "id").limit(limit)


def status_summary(runs: DataFrame, now) -> DataFrame:
    """Runs of the current day by status, as one row."""
    today = F.to_date("started_at") == F.to_date(_moment(now))
    def of(status):
        return F.count_if(today & (F.col("status") == status)).alias(status)
    return runs.agg(F.count_if(today).alias("total"), of("success"), of("failed"), of("running"), of("cancelled"))


def run_timeline(runs: DataFrame, now, hours: int = 24) -> DataFrame:
    """One bar per run of the last hours: where it starts, how long it is, its status and rows.

    Bars stay rows. Gathering the bars of one target into an array would put all
    runs of a busy target into one task.
    """
    since = _moment(now) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return (runs.filter((F.col("started_at") > since) & (F.col("started_at") <= _moment(now)))
            .select("target_name", "id", "started_at",
                    (F.unix_micros(F.col("started_at").cast("timestamp"))
                     - F.unix_micros(since.cast("timestamp"))).alias("offset_micros"),
                    "duration_sec", "status", "rows_processed"))


def freshness(updates: DataFrame, thresholds: DataFrame | None, now, default_seconds: int = 86400) -> DataFrame:
    """Age of every table: ``fresh``, ``stale`` beyond its threshold, ``critical`` beyond twice that.

    ``updates`` has ``table_name, updated_at``; ``thresholds`` has ``table_name, max_age_seconds``.
    """
    last = updates.groupBy("table_name").agg(F.max("updated_at").alias("last_updated"))
    if thresholds is not None:
        last = last.join(thresholds.select("table_name", "max_age_seconds"), "table_name", "left")
    else:
        last = last.withColumn("max_age_seconds", F.lit(None).cast("bigint"))
    limit = F.coalesce("max_age_seconds", F.lit(default_seconds).cast("bigint"))
    age = F.unix_seconds(_moment(now).cast("timestamp")) - F.unix_seconds(F.col("last_updated").cast("timestamp"))
    return last.select("table_name", "last_updated", limit.alias("max_age_seconds"), age.alias("age_seconds")).withColumn(
        "level", F.when(F.col("age_seconds") > 2 * F.col("max_age_seconds"), "critical")
        .when(F.col("age_seconds") > F.col("max_age_seconds"), "stale").otherwise("fresh"))


def slowest_runs(runs: DataFrame, k: int = 10, by: str = "duration_sec") -> DataFrame:
    """The k longest runs, or the heaviest with ``by='rows_processed'``."""
    return runs.orderBy(F.col(by).desc_nulls_last(), "id").limit(k)


def expected_slots(schedules: DataFrame, start, end) -> DataFrame:
    """Every slot of ``target_id, first_slot, every_seconds`` between two moments, both included."""
    first = F.unix_seconds(F.col("first_slot").cast("timestamp"))
    low, high = (F.unix_seconds(_moment(m).cast("timestamp")) for m in (start, end))
    step = F.col("every_seconds").cast("bigint")
    begin = first + F.greatest(F.ceil((low - first) / step), F.lit(0)) * step
    numbers = F.when(begin <= high, F.sequence(begin, high, step))
    return schedules.select("target_id", F.explode(numbers).alias("s")).select(
        "target_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("slot"))


def late_runs(schedules: DataFrame, runs: DataFrame, start, end, tolerance_seconds: int = 0) -> DataFrame:
    """Slots that have no run: none started from the slot until the tolerance or the next slot is over."""
    slots = expected_slots(schedules, start, end)
    first = F.unix_seconds(F.col("first_slot").cast("timestamp"))
    started = F.unix_seconds(F.col("started_at").cast("timestamp"))
    step = F.col("every_seconds").cast("bigint")
    behind = F.pmod(started - first, step)
    # each run belongs to one slot, so slots and runs meet by equality; many runs of a slot become one row
    covered = (runs.join(schedules, "target_id").filter(started >= first)
               .withColumn("slot", F.timestamp_seconds(started - behind).cast("timestamp_ntz")))
    if tolerance_seconds:
        covered = covered.filter(behind <= tolerance_seconds)
    return slots.join(covered.select("target_id", "slot").distinct(), ["target_id", "slot"], "left_anti")


def attention_list(runs: DataFrame, late: DataFrame, fresh: DataFrame) -> DataFrame:
    """Failed runs, late slots and stale tables in one list, the most severe first."""
    failed = runs.filter("status = 'failed'").select(
        F.lit(1).alias("severity"), F.lit("failed").alias("status"), F.col("target_id").cast("string").alias("name"),
        F.col("started_at").cast("timestamp_ntz").alias("at"))
    missed = late.select(F.lit(2).alias("severity"), F.lit("late").alias("status"),
                         F.col("target_id").cast("string").alias("name"), F.col("slot").alias("at"))
    old = fresh.filter("level <> 'fresh'").select(
        F.when(F.col("level") == "critical", 1).otherwise(3).alias("severity"), F.col("level").alias("status"),
        F.col("table_name").cast("string").alias("name"), F.col("last_updated").cast("timestamp_ntz").alias("at"))
    return failed.unionByName(missed).unionByName(old).orderBy("severity", F.desc("at"), "status", "name")


def step_rows(runs: DataFrame) -> DataFrame:
    """One row per step of every run."""
    return runs.select(F.col("id").alias("run_id"), F.posexplode("step_timelines").alias("position", "step")).select(
        "run_id", "position", "step.*")


def log_rows(runs: DataFrame, level: str | None = None) -> DataFrame:
    """One row per log line of every run, optionally of one level."""
    lines = runs.select(F.col("id").alias("run_id"), F.posexplode("logs").alias("position", "line")).select(
        "run_id", "position", "line.*")
    return lines.filter(F.col("level") == level) if level else lines


def retry_last(runs: DataFrame, slot: Column, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """The last attempt of every target and slot, and how many there were.

    ``max_by`` combines on the map side, so a slot with very many attempts is no problem.
    """
    order = F.struct("attempt", "started_at", "id")
    last = runs.withColumn("slot", slot).groupBy(*keys, "slot").agg(
        F.max_by(F.struct(*[c for c in runs.columns if c not in keys]), order).alias("last"),
        F.count(F.lit(1)).alias("attempts"))
    return last.select(*keys, "slot", "attempts", "last.*")
