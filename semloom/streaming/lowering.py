"""An extension: exact operators of a plan over a stream.

Projections, filters, derived columns, renames and joins with static tables run on any stream; group-bys
need an event-time column, a watermark and a window. Model operators and limits have no streaming form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exact import _FUNCS, aggregate_names
from ..plans.pipeline import Pipeline

STREAMABLE = {"project", "filter", "map", "add_col_suffix", "join", "union"}


def stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def lower_stream(plan: Pipeline) -> DataFrame:
    if bad := [n.kind for n in plan.nodes if n.kind not in STREAMABLE]:
        raise ValueError(f"no streaming form of {bad}")
    return plan.lower()


def windowed(df: DataFrame, time: str, width: str, late: str, fields: Sequence[str], funcs: Sequence[str], agg_fields: Sequence[str]) -> DataFrame:
    """Grouped aggregates per tumbling window; rows later than the watermark are left out, as state must end."""
    aggs = [_FUNCS[f](F.col(c)).alias(n) for f, c, n in zip(funcs, agg_fields, aggregate_names(funcs, agg_fields), strict=True)]
    return df.withWatermark(time, late).groupBy(F.window(time, width), *fields).agg(*aggs)
