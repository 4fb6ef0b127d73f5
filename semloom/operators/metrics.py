"""Cost, latency, stability and error figures of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Price:
    """Dollars per million tokens; above ``tier`` prompt tokens the long rates hold for the whole call."""

    read: float
    write: float
    cached: float = 0.0
    tier: int | None = None
    long_read: float | None = None
    long_write: float | None = None
    long_cached: float | None = None


def token_cost(price: Price, prompt: Column, completion: Column, cached: Column | None = None) -> Column:
    """Dollars of a call; ``prompt`` includes cached tokens."""
    cached = F.lit(0) if cached is None else cached

    def rate(base: float, long: float | None) -> Column:
        if price.tier is None or long is None:
            return F.lit(base / 1e6)
        return F.when(prompt > price.tier, F.lit(long / 1e6)).otherwise(F.lit(base / 1e6))

    return (prompt - cached) * rate(price.read, price.long_read) + cached * rate(price.cached, price.long_cached) + completion * rate(price.write, price.long_write)


def token_cost_joined(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``cost`` of calls by model from ``prices(model, tier, read, cached, write)``, a row per tier, tier 0 the base.

    The highest tier that the prompt strictly exceeds sets the rates; the price table is small and broadcast.
    """
    rates = prices.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("tier", "read", "cached", "write"))).alias("__t"))
    priced = calls.join(F.broadcast(rates), "model", "left")
    fit = F.element_at(F.filter("__t", lambda t: (t["tier"] == 0) | (F.col("prompt_tokens") > t["tier"])), -1)
    cost = (F.col("prompt_tokens") - F.col("cached_tokens")) * fit["read"] + F.col("cached_tokens") * fit["cached"] + F.col("completion_tokens") * fit["write"]
    return priced.withColumn("cost", cost / 1e6).drop("__t")


def long_prompt_tier(prices: list[Price]) -> int | None:
    """The lowest number of prompt tokens above which any of the prices rises."""
    return min((p.tier for p in prices if p.tier is not None), default=None)


def attributed(delta: float, plans: list[str]) -> dict[str, float]:
    """A step's cost split evenly over the plans it touched."""
    return {p: delta / len(set(plans)) for p in dict.fromkeys(plans)}


def scaled_tokens(tokens: int, subset_rows: int, dataset_rows: int) -> int:
    """Tokens that a prompt over all rows of a subset takes over all rows of its table."""
    return -(-tokens * dataset_rows // subset_rows) if subset_rows else 0


def spread_over(rows: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    """Figures of one call that made several rows, divided evenly over them."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return rows.withColumns({m: F.col(m) / n for m in measures})


def results_summary(rows: DataFrame, by: str, measures: dict[str, int]) -> DataFrame:
    """Per kind of operator: ``n``, and the rounded sum and mean of each measure, given with its decimals."""
    aggs = [F.round(g(m), d).alias(f"{m}_{name}") for m, d in measures.items() for name, g in (("sum", F.sum), ("mean", F.avg))]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *aggs)


def long_prompt_warnings(df: DataFrame, length: Column, tokens_per_char: float, tier: int, share: float = 0.8) -> DataFrame:
    """Rows whose estimated prompt comes within ``share`` of a long-prompt tier."""
    return df.withColumn("est_tokens", F.ceil(length * tokens_per_char).cast("long")).filter(F.col("est_tokens") >= share * tier)


def operator_stats(stats: DataFrame) -> DataFrame:
    """Per operator: summed cost, latency and tokens, records in and records passed."""
    return stats.groupBy("op_id", "op_type").agg(
        F.sum("cost_usd").alias("cost_usd"), F.sum("latency_s").alias("latency_s"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count(F.lit(1)).alias("num_records"), F.count_if("passed").alias("num_passed"),
    )


def repeated_runs(runs: DataFrame, plan: str, measures: list[str]) -> DataFrame:
    """Mean and sample deviation of each measure over a plan's executions."""
    return runs.groupBy(plan).agg(*[f(m).alias(f"{m}_{n}") for m in measures for n, f in (("avg", F.avg), ("std", F.stddev_samp))])


def unstable_records(outputs: DataFrame, execution: str, id_col: str, n_executions: int) -> DataFrame:
    """One row ``n_unstable``: ids whose rows differ between executions; missing from one counts as different."""
    cells = [c for c in outputs.columns if c not in (execution, id_col)]
    row = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}) if cells else F.lit("{}")
    per = outputs.groupBy(id_col, execution).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    ids = per.groupBy(id_col).agg(F.count_distinct("rows").alias("forms"), F.count(F.lit(1)).alias("seen"))
    return ids.agg(F.count_if((F.col("forms") > 1) | (F.col("seen") < n_executions)).alias("n_unstable"))


def top_errors(errors: DataFrame, op: str, message: str, n: int = 3, width: int = 300) -> DataFrame:
    """Per operator the n most frequent messages, cut to ``width``, as ``<count>x <message>``."""
    counts = errors.groupBy(op, F.substring(message, 1, width).alias("message")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(op).orderBy(F.desc("n"), "message"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n).select(op, "rank", F.concat(F.col("n").cast("string"), F.lit("x "), "message").alias("error"))


def join_estimate(left: int, right: int, selectivity: float = 0.5, seconds_per_pair: float = 0.001) -> dict[str, float]:
    """What a nested-loops join of so many rows would give and take; a guard before model calls on pairs."""
    return {"pairs": left * right, "rows": selectivity * left * right, "seconds": seconds_per_pair * left * right, "cost_usd": 0.0, "quality": 1.0}
