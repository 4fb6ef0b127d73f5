"""The driver's side of a search for plans: budgets in view, histories within bounds, routes, prices, records and logs."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from statistics import mean, stdev
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import Price
from ..operators.provider import Provider
from .pipeline import Pipeline

HISTORY_CHARS, BLOCKS_CHARS = 200_000, 80_000
SAMPLE_CHARS, SAMPLES_CHARS = 9_000, 20_000


def trim_history(messages: Sequence[str], most: int = HISTORY_CHARS) -> list[str]:
    """The task, which is the first message, and as many of the latest as fit with it."""
    if not messages:
        return []
    room, kept = most - len(messages[0]), []
    for m in reversed(messages[1:]):
        if len(m) > room:
            break
        room -= len(m)
        kept.append(m)
    return [messages[0], *reversed(kept)]


def trim_blocks(blocks: Sequence[str], most: int = BLOCKS_CHARS) -> list[str]:
    """The latest blocks that fit; the last one in any case."""
    return trim_history(["", *blocks], most)[1:] or list(blocks[-1:])


def footer(step_usd: float, total_usd: float, subset_rows: int, dataset_rows: int) -> str:
    return f"[step ${step_usd:.4f} | total ${total_usd:.4f} | subset {subset_rows} rows | dataset {dataset_rows} rows]"


def final_record(query: str, plan: str, runs: Sequence[Mapping[str, float]]) -> dict[str, Any]:
    """A query's entry: each run of the chosen plan, and mean and deviation of every figure they share."""
    names = sorted(set.intersection(*[{k for k, v in r.items() if isinstance(v, int | float)} for r in runs])) if runs else []
    figures = {n: {"mean": mean(r[n] for r in runs), "std": stdev(r[n] for r in runs) if len(runs) > 1 else None} for n in names}
    return {"query": query, "plan": plan, **{f"run{k}": dict(sorted(r.items())) for k, r in enumerate(runs, 1)}, "figures": figures}


@dataclass(frozen=True)
class Route:
    """Where a model's calls go, and which settings it takes."""

    endpoint: str
    direct: bool
    takes: frozenset[str]


def route(model: str, direct: Mapping[str, Route], router: Route) -> Route:
    """The route of the longest prefix of the model's name, or else the common router."""
    fits = [p for p in direct if model.startswith(p)]
    return direct[max(fits, key=len)] if fits else router


def request(model: str, settings: Mapping[str, Any], direct: Mapping[str, Route], router: Route) -> dict[str, Any]:
    """Settings of a call with those left out that its route does not take."""
    way = route(model, direct, router)
    return {"model": model, "endpoint": way.endpoint, **{k: v for k, v in settings.items() if k in way.takes}}


@dataclass
class Models:
    """Known models and their prices."""

    prices: dict[str, Price] = field(default_factory=dict)

    def register(self, model: str, price: Price) -> None:
        self.prices[model] = price

    def repriced(self, calls: DataFrame) -> DataFrame:
        """``cost`` of ``calls(model, prompt_tokens, completion_tokens, cached_tokens)`` at the registered prices; null for unknown models."""
        from ..operators.metrics import token_cost

        cost = F.lit(None).cast("double")
        for model, price in self.prices.items():
            cost = F.when(F.col("model") == model, token_cost(price, F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cached_tokens"))).otherwise(cost)
        return calls.withColumn("cost", cost)

    @staticmethod
    def plain(messages: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
        """Messages without marks for a provider's prompt cache."""
        return [{k: [{a: b for a, b in x.items() if a != "cache_control"} if isinstance(x, Mapping) else x for x in v] if isinstance(v, list) else v for k, v in m.items() if k != "cache_control"} for m in messages]


def plan_samples(plan: Pipeline, provider: Provider | None = None, n: int = 5, cell: int = SAMPLE_CHARS // 10, total: int = SAMPLES_CHARS) -> list[dict[str, Any]]:
    """A few rows that go into and come out of each operator of the plan, cut to a number of characters; for a run on a subset.

    A filter's or join's rows say whether they passed where they can be told by their columns.
    """
    out, used = [], 0
    for k, node in enumerate(plan.nodes):
        from dataclasses import replace

        columns = plan.columns if k == len(plan.nodes) - 1 else None
        before = _shortened(replace(plan, nodes=plan.nodes[:k], columns=_columns_after(plan, k)), provider, n, cell)
        after = _shortened(replace(plan, nodes=plan.nodes[: k + 1], columns=columns or _columns_after(plan, k + 1)), provider, n, cell)
        shown = {"op": f"{plan.name}_op{k}_{node.kind}", "in": before, "out": after}
        if node.kind in ("filter", "sem_filter", "rag_filter"):
            shown["passed"] = [r in after for r in before]
        used += len(str(shown))
        if used > total:
            break
        out.append(shown)
    return out


def _columns_after(plan: Pipeline, k: int) -> tuple[str, ...]:
    """The columns of a plan after its first k steps, from building these again."""
    from ..operators import exact

    columns = tuple(plan.source.columns)
    for node in plan.nodes[:k]:
        a = node.attributes
        match node.kind:
            case "project":
                columns = tuple(a["cols"])
            case "map":
                columns += tuple(a["columns"]) if isinstance(a["columns"], dict) else tuple(c["name"] for c in a["cols"])
            case "add_col_suffix":
                columns = tuple(c + a["suffix"] for c in columns)
            case "join" | "sem_join":
                columns += tuple(exact.joined_names(columns, node.inputs[0].columns).values())
            case "groupby":
                columns = (*a["fields"], *exact.aggregate_names(a["funcs"], a["agg_fields"]))
            case "sem_map" | "rag_map":
                columns += tuple(c["name"] for c in a["cols"])
            case "sem_agg":
                names = tuple(c["name"] for c in a["cols"])
                columns = columns + names if a["keep_inputs"] else (*a["group_by"], *names)
        if a.get("capture"):
            columns += (a["capture"],)
    return columns


def _shortened(plan: Pipeline, provider: Provider | None, n: int, cell: int) -> list[dict[str, Any]]:
    df = plan.lower(provider, ignore_limits=True).limit(n)
    return [r.asDict() for r in df.select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, cell).alias(c) for c in plan.columns]).collect()]


def run_log(folder: str | Path, run: str) -> logging.Logger:
    """A logger whose warnings and errors also go to a file of this run."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger(f"semloom.{run}")
    if not log.handlers:
        to_file = logging.FileHandler(Path(folder) / f"{run}.log", delay=True)
        to_file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        to_file.setLevel(logging.WARNING)
        log.addHandler(to_file)
    return log
