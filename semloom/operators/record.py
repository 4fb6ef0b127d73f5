"""What the operators of a plan did in a run: rows, errors, tokens, cost, as observed by the run itself."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .metrics import Price

#: Messages that are kept for each operator, and their length.
MESSAGES, WIDTH = 3, 300
STATS = "op_name string, op_type string, op_id string, num_records long, num_passed long, num_errors long, input_tokens long, output_tokens long, cost_usd double"


class Record:
    """Collects observations while a plan is lowered, and their figures after an action has run it.

    Counts are exact. The most frequent messages are kept by a sketch of fixed size, so they cost no memory
    that grows with the rows. Figures are those of one action on the lowered frame.
    """

    def __init__(self, prices: Mapping[str, Price] | None = None):
        self.prices = dict(prices or {})
        self.seen: list[tuple[str, Any, Observation]] = []

    def _observe(self, df: DataFrame, name: str, node: Any, passed: Column, error: Column, tokens_in: Column, tokens_out: Column) -> DataFrame:
        watched = Observation(f"{name}-{len(self.seen)}")
        self.seen.append((name, node, watched))
        messages = F.approx_top_k(F.substring(error, 1, WIDTH), F.lit(MESSAGES + 1)) if hasattr(F, "approx_top_k") else F.call_function("approx_top_k", F.substring(error, 1, WIDTH), F.lit(MESSAGES + 1))
        return df.observe(
            watched, F.count(F.lit(1)).alias("num_records"), F.count_if(passed).alias("num_passed"), F.count(error).alias("num_errors"),
            F.coalesce(F.sum(tokens_in), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(tokens_out), F.lit(0)).alias("output_tokens"), messages.alias("messages"),
        )

    def of_rows(self, name: str, node: Any) -> Callable[[DataFrame, Column, Column], DataFrame]:
        none = F.lit(0).cast("long")
        return lambda df, passed, error: self._observe(df, name, node, passed, error, none, none)

    def of_answers(self, name: str, node: Any) -> Callable[[DataFrame, Column], DataFrame]:
        def watch(df: DataFrame, skipped: Column) -> DataFrame:
            answer = F.col("__answer")
            verdict = node.kind in ("sem_filter", "sem_join", "rag_filter")
            passed = F.coalesce(answer["value"]["passed"], F.lit(False)) if verdict else answer["error"].isNull()
            return self._observe(df, name, node, skipped | passed, F.when(~skipped, answer["error"]), answer["tokens_in"], answer["tokens_out"])

        return watch

    def rows(self) -> list[dict[str, Any]]:
        """A row an operator, in the order of the plan."""
        out = []
        for name, node, watched in self.seen:
            got = watched.get
            price = self.prices.get(node.attributes.get("model", ""))
            cost = (got["input_tokens"] * price.read + got["output_tokens"] * price.write) / 1e6 if price else 0.0
            figures = {k: got[k] for k in ("num_records", "num_passed", "num_errors", "input_tokens", "output_tokens")}
            out.append({"op_name": name, "op_type": node.kind, "op_id": node.fingerprint(), **figures, "cost_usd": cost})
        return out

    def stats(self, spark: SparkSession) -> DataFrame:
        names = [x.split()[0] for x in STATS.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows()], STATS)

    def errors(self, spark: SparkSession) -> DataFrame:
        """``op_name, rank, n, error``: the most frequent messages of each operator."""
        rows = []
        for name, _, watched in self.seen:
            found = sorted(((m["count"], m["item"]) for m in watched.get["messages"] if m["item"] is not None), key=lambda x: (-x[0], x[1]))
            rows += [(name, k, n, f"{n}x {text}") for k, (n, text) in enumerate(found[:MESSAGES], 1)]
        return spark.createDataFrame(rows, "op_name string, rank int, n long, error string")
