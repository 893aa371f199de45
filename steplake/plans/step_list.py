"""A list of steps applied in order, its row counts, and the two built-in step lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, functions as F

from steplake.operators.steps import STEPS


@dataclass(frozen=True)
class Step:
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    name: str = ""
    enabled: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        if self.kind not in STEPS:
            raise ValueError(f"unknown step kind {self.kind!r}; use one of {', '.join(STEPS)}")
        return STEPS[self.kind](df, **self.params)


def as_step(step: Step | dict) -> Step:
    return step if isinstance(step, Step) else Step(**step)


def active_steps(steps: Sequence[Step | dict]) -> list[Step]:
    return [s for s in map(as_step, steps) if s.enabled]


def run_steps(df: DataFrame, steps: Sequence[Step | dict]) -> DataFrame:
    """Apply the enabled steps in order: one lazy plan, whatever the number of steps."""
    return reduce(lambda frame, step: step.apply(frame), active_steps(steps), df)


def _stages(df: DataFrame, steps: Sequence[Step | dict]) -> Iterator[tuple[int, Step, DataFrame, DataFrame]]:
    for number, step in enumerate(active_steps(steps), 1):
        result = step.apply(df)
        yield number, step, df, result
        df = result


def step_row_counts(df: DataFrame, steps: Sequence[Step | dict]) -> DataFrame:
    """Rows in and out of every step, exact also when tasks are repeated.

    Every count is its own aggregate over a pruned plan; identical shuffles are
    shared between them. Use :func:`run_observed` to count while writing instead.
    """
    spark = df.sparkSession
    stages = list(_stages(df, steps))
    if not stages:
        return spark.createDataFrame([], "step int, kind string, name string, rows_in bigint, rows_out bigint")
    counts = [df] + [result for *_, result in stages]
    rows = [frame.select(F.lit(i).alias("position")).groupBy("position").count()
            for i, frame in enumerate(counts)]
    # one row per step from here on
    counted = reduce(DataFrame.unionAll, rows).agg(F.map_from_entries(
        F.collect_list(F.struct("position", "count"))).alias("counts"))
    outcome = F.array(*[
        F.struct(F.lit(number).alias("step"), F.lit(step.kind).alias("kind"),
                 F.lit(step.name or step.kind).alias("name"),
                 F.coalesce(F.try_element_at("counts", F.lit(number - 1)), F.lit(0)).alias("rows_in"),
                 F.coalesce(F.try_element_at("counts", F.lit(number)), F.lit(0)).alias("rows_out"))
        for number, step, *_ in stages])
    return counted.select(F.inline(outcome))


def run_observed(df: DataFrame, steps: Sequence[Step | dict], path: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> list[dict[str, Any]]:
    """Write the result and report the rows in and out of every step from the same single pass.

    The counts are metrics: a stage that is repeated after a lost executor is
    counted twice, and a limit stops the steps before it early. The written
    rows are right in any case; use :func:`step_row_counts` for exact counts.
    """
    seen = [Observation()]
    frame = df.observe(seen[0], F.count(F.lit(1)).alias("rows"))
    steps = active_steps(steps)
    for step in steps:
        seen.append(Observation())
        frame = step.apply(frame).observe(seen[-1], F.count(F.lit(1)).alias("rows"))
    frame.write.mode(mode).format(fmt).save(path)
    rows = [o.get["rows"] for o in seen]
    return [{"step": i, "kind": s.kind, "name": s.name or s.kind, "rows_in": rows[i - 1], "rows_out": rows[i]}
            for i, s in enumerate(steps, 1)]


def clean_orders_steps() -> list[Step]:
    """The first order of each customer in each price band."""
    return [
        Step("filter", {"condition": "o_totalprice >= 1000"}, "orders worth a call"),
        Step("drop_null", {"columns": ["o_orderdate", "o_orderstatus"]}, "with date and status"),
        Step("derive", {"column_name": "band", "expression":
                        "CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 250000 THEN 'mid' ELSE 'high' END"}, "price band"),
        Step("deduplicate", {"columns": ["o_custkey", "band"], "order_by": ["o_orderkey"]}, "first of customer and band"),
        Step("aggregate", {"group_by": ["band"], "aggregations": [
            {"column": "o_totalprice", "function": "SUM", "alias": "worth"},
            {"column": "o_custkey", "function": "COUNT", "alias": "customers"}]}, "worth of each band", enabled=False),
    ]


def clean_events_steps() -> list[Step]:
    """Everything but views, with points, most points first."""
    return [
        Step("filter", {"column": "event_type", "operator": "!=", "value": "view"}, "no views"),
        Step("drop_null", {"column": "value"}, "with a value"),
        Step("derive", {"column_name": "points", "expression": "round(value * 10) + user_id % 7"}, "points"),
        Step("rename", {"mapping": {"event_id": "id"}}, "short name"),
        Step("sort", {"columns": [{"column": "points", "ascending": False}, "id"]}, "most points first"),
    ]
