"""Workflows: a graph of nodes, each of which becomes one lazy DataFrame."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from steplake.operators.quality import Rule, evaluate
from steplake.operators.steps import require_columns
from steplake.plans.step_list import Step, run_steps
from steplake.session import ensure_checkpoint_dir
from steplake.sources.sinks import save_as_table, write_files

# The kinds of nodes.
KINDS = ("source", "filter", "steps", "transform_sql", "quality_assert", "python", "destination")


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    data: dict[str, Any] = field(default_factory=dict)
    label: str = ""


@dataclass
class WorkflowResult:
    success: bool
    execution_order: list[str]
    node_results: dict[str, dict[str, Any]]
    outputs: dict[str, DataFrame]
    error: str | None = None


class WorkflowError(ValueError):
    """A node cannot run; the message names it and says why."""


def validate_workflow(nodes: Sequence[Node], edges: Sequence[tuple[str, str]]) -> list[str]:
    """The order to run the nodes in; an error for unknown nodes, repeated ids and cycles."""
    ids = [n.id for n in nodes]
    if len(set(ids)) != len(ids):
        raise WorkflowError("two nodes have the same id")
    for node in nodes:
        if node.type not in KINDS:
            raise WorkflowError(f"node {node.id}: unknown type {node.type!r}; use one of {', '.join(KINDS)}")
    upstream = {i: [] for i in ids}
    for source, target in edges:
        if source not in upstream or target not in upstream:
            raise WorkflowError(f"edge {source} -> {target} names an unknown node")
        upstream[target].append(source)
    sorter = TopologicalSorter(upstream)
    try:
        sorter.prepare()
    except CycleError as error:
        raise WorkflowError("the workflow has a cycle: " + " -> ".join(reversed(error.args[1]))) from error
    order = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready(), key=ids.index)
        order += ready
        sorter.done(*ready)
    return order


def check_edge(upstream: DataFrame, needed: Sequence[str]) -> None:
    """Refuse an edge whose source lacks a column the target needs, naming the column."""
    try:
        require_columns(upstream, needed)
    except ValueError as error:
        raise WorkflowError(str(error)) from error


def run_sql_node(spark: SparkSession, sql: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """SQL over the upstream results: ``__input__`` is the first, ``__input_<node id>__`` any of them.

    Any other table of the session may be joined.
    """
    views, text = [], sql
    first = next(iter(inputs), None)
    for node_id, frame in inputs.items():
        view = f"steplake_{uuid.uuid4().hex}"
        frame.createOrReplaceTempView(view)
        views.append(view)
        text = re.sub(rf"__input_{re.escape(node_id)}__", view, text)
        if node_id == first:
            text = text.replace("__input__", view)
    try:
        return spark.sql(text)
    finally:
        # the analysed plan no longer needs the names
        for view in views:
            spark.catalog.dropTempView(view)


def plan_node(spark: SparkSession, node: Node, inputs: Mapping[str, DataFrame],
              tables: Mapping[str, DataFrame]) -> DataFrame:
    """The node's result as a lazy DataFrame. Column errors appear here, before anything runs."""
    if node.type == "source":
        name = node.data["table"]
        return tables[name] if name in tables else spark.table(name)
    if not inputs:
        raise WorkflowError(f"node {node.id} has no input")
    df = next(iter(inputs.values()))
    check_edge(df, node.data.get("requires", []))
    try:
        match node.type:
            case "filter":
                return df.filter(F.expr(node.data.get("condition", "1=1")))
            case "steps":
                return run_steps(df, [s if isinstance(s, Step) else Step(**s) for s in node.data["steps"]])
            case "transform_sql":
                return run_sql_node(spark, node.data.get("sql", "SELECT * FROM __input__"), inputs)
            case "python":
                function: Callable[..., DataFrame] = node.data["function"]
                return function(*inputs.values(), **node.data.get("params", {}))
        return df
    except (AnalysisException, ParseException, ValueError) as error:
        raise WorkflowError(f"node {node.id}: {str(error).splitlines()[0]}") from error


def plan_workflow(spark: SparkSession, nodes: Sequence[Node], edges: Sequence[tuple[str, str]],
                  tables: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """One lazy DataFrame per node. Every node reads the nodes its edges come from."""
    by_id = {n.id: n for n in nodes}
    planned: dict[str, DataFrame] = {}
    for node_id in validate_workflow(nodes, edges):
        inputs = {s: planned[s] for s, t in edges if t == node_id}
        planned[node_id] = plan_node(spark, by_id[node_id], inputs, tables or {})
    return planned


def _rule(node: Node) -> Rule:
    data = node.data
    return Rule(node.id, data.get("rule", "not_null"), data.get("column"), data.get("params", {}),
                data.get("severity", "error"))


def run_workflow(spark: SparkSession, nodes: Sequence[Node], edges: Sequence[tuple[str, str]],
                 tables: Mapping[str, DataFrame] | None = None) -> WorkflowResult:
    """Run checks and destinations in dependency order and stop at the first failure.

    A quality check and a destination are the only nodes that start a job. A
    node's row count is a metric of the job that writes it on (see
    ``run_observed`` for what that means); a destination's is read back from
    what was written. A node that several jobs read is a checkpoint in the shared folder.
    """
    by_id = {n.id: n for n in nodes}
    try:
        order = validate_workflow(nodes, edges)
    except WorkflowError as error:
        return WorkflowResult(False, [], {}, {}, str(error))
    feeds = {i: [t for s, t in edges if s == i] for i in by_id}
    frames: dict[str, DataFrame] = {}
    counters: dict[str, Observation] = {}
    results: dict[str, dict[str, Any]] = {}
    for node_id in order:
        node = by_id[node_id]
        inputs = {s: frames[s] for s, t in edges if t == node_id}
        try:
            df = plan_node(spark, node, inputs, tables or {})
            message = _run_node(spark, node, df)
            if node.type != "destination":
                counters[node_id] = Observation()
                df = df.observe(counters[node_id], F.count(F.lit(1)).alias("rows"))
            if _jobs_below(node_id, by_id, feeds) > 1 and node.type not in ("source", "destination"):
                ensure_checkpoint_dir(spark)
                df = df.checkpoint()
        except Exception as error:  # whatever a node raises ends the run and is reported
            results[node_id] = {"status": "error", "message": str(error).splitlines()[0]}
            return WorkflowResult(False, order, results, frames,
                                  f"node {node.label or node_id} failed: {results[node_id]['message']}")
        frames[node_id] = df
        results[node_id] = {"status": "success", "message": message}
    for node_id, counter in counters.items():
        if _writes_below(node_id, by_id, feeds):
            results[node_id]["rows"] = counter.get["rows"]
            results[node_id]["message"] = f"{results[node_id]['rows']:,} rows"
    return WorkflowResult(True, order, results, frames)


def _run_node(spark: SparkSession, node: Node, df: DataFrame) -> str:
    if node.type == "quality_assert":
        rule = _rule(node)
        outcome = evaluate(df, [rule], node.label).first()
        if not outcome["passed"] and rule.severity == "error":
            raise WorkflowError(f"quality check {node.id} failed: {outcome['message']}")
        return outcome["message"]
    if node.type == "destination":
        path = node.data.get("path")
        if path and not node.data.get("target_table"):
            write_files(df, path, node.data.get("mode", "overwrite"))
            rows = spark.read.parquet(path).count() if path.endswith(".parquet") else None
        else:
            name = node.data.get("target_table", f"out_{node.id}")
            save_as_table(df, name, node.data.get("mode", "overwrite"), path)
            rows = spark.table(name).count()
        return "written" if rows is None else f"{rows:,} rows stored"
    return "planned"


def _below(node_id: str, feeds: Mapping[str, Sequence[str]]) -> set[str]:
    seen, todo = set(), list(feeds[node_id])
    while todo:
        current = todo.pop()
        if current not in seen:
            seen.add(current)
            todo += feeds[current]
    return seen


def _jobs_below(node_id: str, by_id: Mapping[str, Node], feeds: Mapping[str, Sequence[str]]) -> int:
    if len(feeds[node_id]) < 2:
        return 0
    return sum(by_id[i].type in ("destination", "quality_assert") for i in _below(node_id, feeds))


def _writes_below(node_id: str, by_id: Mapping[str, Node], feeds: Mapping[str, Sequence[str]]) -> bool:
    return any(by_id[i].type == "destination" for i in _below(node_id, feeds))
