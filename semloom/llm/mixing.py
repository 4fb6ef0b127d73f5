"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Method. Each source should get its weight's share of all words. A source gives at most ``epochs`` times
its own words; what it cannot take is shared among the others by weight, until none is above its cap.
A document of a source that repeats r times is taken floor(r) times, and once more if it comes early
enough in a seeded order of its source's documents: those whose middle word lies below the words still
missing. So each source misses its target by less than its one document at the cut.

Scale. Only DataFrame functions. Words are counted where the rows lie; sizes are summed per (source,
slice of the seeded order) before anything moves, so that a source with most of the rows is no hot key;
only the one slice per source where the cut falls is sorted. The water level comes from rounds of scalar
sums over the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of the seeded hash that name a slice: 4096 slices of each source.
SLICE = 3


def words_in(text) -> F.Column:
    """Number of runs of characters other than the six ASCII white-space ones; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def water_level(sources: DataFrame, epochs: int) -> tuple[list[float], float]:
    """Rounds of clamping: the level after each round; a source is capped if a level offers it more than its cap."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    levels: list[float] = []
    while True:
        capped = F.lit(False)
        for level in levels:
            capped = capped | (epochs * F.col("source_size").cast("double") < F.lit(level) * F.col("weight"))
        taken, weights, n = sources.agg(
            F.sum(F.when(capped, epochs * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight"))), F.sum(capped.cast("long"))
        ).first()
        if not weights:
            return levels, levels[-1] if levels else 0.0
        level = float(total - taken) / float(weights)
        if levels and level == levels[-1]:
            return levels, level
        levels.append(level)


def targets(sized: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` of ``sized(source, size)``: sources in code-point order, null last, weigh 1, 2, 3 in turn."""
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row per source, summed before
    sources = materialize(sums.withColumn("weight", ((place - 1) % 3 + 1).cast("long")), "mix-weights")
    levels, level = water_level(sources, epochs)
    capped = F.lit(False)
    for x in levels:
        capped = capped | (epochs * F.col("source_size").cast("double") < F.lit(x) * F.col("weight"))
    return sources.withColumn("target", F.when(capped, (epochs * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight")))


def repetitions(docs: DataFrame, column: str, epochs: int = EPOCHS, seed: str = SEED, small: bool = False) -> DataFrame:
    """The given column of ``docs(doc_id, text, source)`` with ``__size``, ``__source_size``, ``__target`` and ``__times`` for every row.

    Words are counted once if the column is ``small``; rows with their texts are read again rather than written again.
    """
    draw = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(column, words_in(F.col("text").cast("string")).alias("__size"), F.col("source").cast("string").alias("__source"), draw.alias("__draw"))
    rows = rows.withColumn("__slice", F.substring("__draw", 1, SLICE))
    if small:
        rows = materialize(rows, "mix-rows")
    plan = targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")), epochs)
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", share).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    slices = rows.groupBy("__source", "__slice").agg(F.sum("__size").alias("in_slice"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("__source").alias("source"), F.col("__slice").alias("slice"), "in_slice").withColumn("before", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("s.source"))
    cuts = slices.alias("s").join(plan.alias("p"), same).filter("before <= missing and before + in_slice > missing")
    cuts = cuts.groupBy("p.source").agg(F.min("slice").alias("cut"), F.min_by("before", "slice").alias("before"))
    plan = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "cut", "before")
    plan = materialize(plan, "mix-plan").withColumnsRenamed({"source": "p_source"})
    joined = rows.join(plan, rows["__source"].eqNullSafe(F.col("p_source")))
    sorted_part = joined.filter(F.col("__slice") == F.col("cut"))
    running = Window.partitionBy("p_source").orderBy("__draw", "__size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("__size").over(running), F.lit(0))
    cut_part = sorted_part.withColumn("__extra", (2 * ahead + F.col("__size") <= 2 * F.col("missing")).cast("long"))
    other = joined.filter(F.col("cut").isNull() | (F.col("__slice") != F.col("cut"))).withColumn("__extra", F.when(F.col("cut").isNull(), (F.col("missing") > 0).cast("long")).otherwise((F.col("__slice") < F.col("cut")).cast("long")))
    both = other.unionByName(cut_part)
    times = F.when(F.col("__size") > 0, F.col("whole") + F.col("__extra")).otherwise(0)
    return both.select(column, "__size", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), times.alias("__times"))


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs(doc_id, text, source)``.

    A null source is a source of its own, the last one; null, empty and blank texts have size 0 and are
    never taken; very long texts count whole. Repeated rows are rows of their own; ties of the seeded order
    (rows of one doc_id) go by size. An empty table gives an empty one; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    out = repetitions(docs, "doc_id", epochs, seed, small=True)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__times") * F.col("__size")).alias("taken"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document stands in the result as often as the mix takes it, with the columns it came with."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    out = repetitions(packed, "row").filter("__times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select("row.*")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) END::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS draw
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), sources AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sums
), levels(n, level) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE / sum(weight)::DOUBLE FROM sources)
  UNION ALL
  SELECT n + 1, (SELECT (sum(source_size) - sum(CASE WHEN 3.0::DOUBLE * source_size < level * weight THEN 3 * source_size ELSE 0 END))::DOUBLE
                        / nullif(sum(CASE WHEN 3.0::DOUBLE * source_size < level * weight THEN 0 ELSE weight END), 0)::DOUBLE FROM sources)
  FROM levels WHERE n < 60 AND level IS NOT NULL
), top AS (SELECT max(level) AS level FROM levels
), plan AS (
  SELECT source, source_size, CASE WHEN 3.0::DOUBLE * source_size < level * weight THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target
  FROM sources, top
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM plan
), ranked AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS missing,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY draw, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN 2 * ahead + size <= 2 * missing THEN 1 ELSE 0 END END * size)::BIGINT AS taken
FROM ranked
"""
