"""Plans as JSON: what a plan does, without its data or its code."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame

from .pipeline import Pipeline

_BUILDERS = ("project", "filter", "map", "add_col_suffix", "join", "groupby", "limit", "sem_filter", "sem_map", "sem_join", "sem_agg", "rag_filter", "rag_map", "sort", "union", "distinct")


def to_json(plan: Pipeline, sources: Mapping[str, DataFrame]) -> str:
    """The plan over named sources. Expressions must be SQL strings: Columns and callables have no text form."""
    return json.dumps(_dumped(plan, sources), sort_keys=True)


def _dumped(plan: Pipeline, sources: Mapping[str, DataFrame]) -> dict[str, Any]:
    name = next((n for n, df in sources.items() if df is plan.source), None)
    if name is None:
        raise ValueError(f"the source of {plan.name} has no name")
    steps = []
    for node in plan.nodes:
        _plain(node.attributes, node.kind)
        steps.append({"op": node.kind, "id": node.fingerprint(), **node.attributes, **({"other": _dumped(node.inputs[0], sources)} if node.inputs else {})})
    return {"name": plan.name, "source": name, "steps": steps}


def _plain(value: Any, where: str) -> None:
    if isinstance(value, Column) or callable(value):
        raise ValueError(f"{where}: only SQL text can be written")
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list | tuple) else ():
        _plain(x, where)


def from_json(text: str, sources: Mapping[str, DataFrame]) -> Pipeline:
    """A plan built again step by step, with all checks of the builder; unknown operators, sources and settings are refused."""
    return _loaded(json.loads(text), sources)


def _loaded(spec: Mapping[str, Any], sources: Mapping[str, DataFrame]) -> Pipeline:
    if spec["source"] not in sources:
        raise ValueError(f"no such source: {spec['source']}")
    plan = Pipeline.of(sources[spec["source"]], spec["name"])
    for step in spec["steps"]:
        given = {k: v for k, v in step.items() if k not in ("op", "id", "other")}
        if step["op"] not in _BUILDERS:
            raise ValueError(f"no such operator: {step['op']}")
        build = getattr(plan, step["op"])
        if "other" in step:
            given = {"other": _loaded(step["other"], sources), **given}
        if step["op"] == "map" and not given["cols"]:
            del given["cols"]
        plan = build(*given["order"]) if step["op"] == "sort" else build(**given)
    return plan
