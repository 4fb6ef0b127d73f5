"""Comparing candidate plans on a subset: run each some times, score, keep the frontier of quality and cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import mean, stdev
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import Price
from ..operators.provider import Provider
from ..operators.record import Record
from .pipeline import Pipeline


@dataclass
class Registry:
    """Plans by name and what their executions gave."""

    plans: dict[str, Pipeline] = field(default_factory=dict)
    rows: list[dict[str, Any]] = field(default_factory=list)
    prices: dict[str, Price] = field(default_factory=dict)
    #: What is stored beside a row but not shown to whoever compares plans.
    hidden: tuple[str, ...] = ("quality_judge_cost",)

    def write(self, plan: Pipeline, description: str = "", optimizations: Sequence[str] = ()) -> list[str]:
        if not isinstance(plan, Pipeline):
            raise TypeError("a plan must be a Pipeline")
        self.plans[plan.name] = plan
        self.rows.append({"plan_name": plan.name, "op_type": "write", "description": description, "optimizations": list(optimizations), "plan_str": plan.explain()})
        return [] if optimizations else [f"{plan.name}: no optimizations are recorded"]

    def execute(self, name: str, provider: Provider, evaluate: Callable[[DataFrame], float], price: Callable[[Pipeline], float] = lambda p: 0.0, executions: int = 1) -> dict[str, Any]:
        """Run a plan on its (subset) source without limits and score it; one row an execution, one of means."""
        plan, runs = self.plans[name], []
        for n in range(executions):
            began = time.time()
            record = Record(self.prices)
            out = plan.lower(provider, ignore_limits=True, record=record).persist()
            out.count()
            quality = evaluate(out)
            out.unpersist()
            operators = record.rows()
            cost = sum(r["cost_usd"] for r in operators) if self.prices else price(plan)
            runs.append({"plan_name": name, "op_type": "execute", "execution": n + 1, "quality": quality, "cost_usd": cost, "wall_latency_s": time.time() - began, "operators": operators, "op_errors": {r["op_name"]: r["num_errors"] for r in operators if r["num_errors"]}})
        self.rows += runs
        figures = {}
        for key, label in (("quality", "quality"), ("cost_usd", "cost"), ("wall_latency_s", "latency_wallclock")):
            values = [r[key] for r in runs]
            figures |= {f"{label}_avg": mean(values), f"{label}_std": stdev(values) if len(values) > 1 else None}
        return {"plan_name": name, **figures}

    def summary(self) -> list[dict[str, Any]]:
        """The rows as they are shown."""
        return [{k: v for k, v in r.items() if k not in self.hidden and k != "operators"} for r in self.rows]

    def frontier(self) -> list[str]:
        """Executed plans that no other beats on quality at equal or lower cost."""
        done: dict[str, tuple[float, float]] = {}
        for r in self.rows:
            if r["op_type"] == "execute":
                done[r["plan_name"]] = (r["quality"], r["cost_usd"])
        best = [n for n, (q, c) in done.items() if not any((q2 >= q and c2 <= c and (q2, c2) != (q, c)) for q2, c2 in done.values())]
        return sorted(best, key=lambda n: (-done[n][0], done[n][1], n))


def search(registry: Registry, candidates: Sequence[Pipeline], provider: Provider, evaluate: Callable[[DataFrame], float], price: Callable[[Pipeline], float], patience: int = 3) -> list[str]:
    """Execute candidates in order until the frontier has not changed for ``patience`` plans; the frontier's names."""
    held, idle = [], 0
    for plan in candidates:
        registry.write(plan)
        registry.execute(plan.name, provider, evaluate, price)
        now = registry.frontier()
        idle = 0 if now != held else idle + 1
        held = now
        if idle >= patience:
            break
    return held


def model_price(plan: Pipeline, rows: int, per_call: dict[str, float]) -> float:
    """Calls of each model times its price; pairs for a join. An upper bound, as filters keep at most all rows."""
    return sum((rows * rows if node.kind == "sem_join" else rows) * per_call.get(node.attributes.get("model", ""), 0.0) for _, node in plan.steps() if node.semantic)


def operator_samples(df: DataFrame, n: int = 5, cell: int = 600) -> list[dict[str, str]]:
    """A few rows of an operator's output, cells cut to length."""
    return [r.asDict() for r in df.limit(n).select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, cell).alias(c) for c in df.columns]).collect()]
