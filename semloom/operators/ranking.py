"""Hybrid ranking: BM25, keyphrases, vectors, their blend, and draws from a ranking."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.budgets import gradient_bands
from ..functions.text import cosine, padded_text, phrases_found, tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
PERCENTILES = [p / 100 for p in range(10, 100, 10)]
FLAT_DECIMALS = 3


def query_tokens(query: str) -> list[str]:
    return re.findall("[a-z0-9]+", query.lower())


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that none of the given ones clashes with."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def _raw(n: Column | float, df: Column | float) -> Column:
    n, df = (x if isinstance(x, Column) else F.lit(float(x)) for x in (n, df))
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _part(weight: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return F.coalesce(F.try_divide(weight * tf * (K1 + 1), tf + K1 * (1 - B + B * F.try_divide(dl, avgdl))), F.lit(0.0))


def bm25(docs: DataFrame, text: Column | str, query: str, out: str = "bm25") -> DataFrame:
    """``docs`` with a column ``out``: Okapi scores of the query over all rows, each row a document of its own.

    A term in more than half of the documents has a negative weight and gets EPSILON of the mean weight of
    the vocabulary instead. Repeated query words count as often. One aggregate over the texts, which shuffles
    nothing, gives the number of documents, their mean length and the counts of the query's terms; the
    vocabulary is counted only if such a frequent term asks for its mean. Then every row scores itself, so ids
    play no part: repeated and null ids, and a column of the same name, do no harm.
    """
    text = F.col(text) if isinstance(text, str) else text
    wanted = query_tokens(query)
    terms = list(dict.fromkeys(wanted))
    if not terms:
        return docs.withColumn(out, F.lit(0.0))
    held = fresh(docs.columns, "__words")
    words = docs.select(tokens(F.coalesce(text, F.lit(""))).alias("w"))
    counts = [F.count_if(F.array_contains("w", t)).alias(f"d{i}") for i, t in enumerate(terms)]
    n, avgdl, *dfs = words.agg(F.count(F.lit(1)), F.avg(F.size("w")), *counts).first()
    weights = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t, df in zip(terms, dfs, strict=True) if df}
    if not weights:
        return docs.withColumn(out, F.lit(0.0))
    if min(weights.values()) < 0:
        vocabulary = words.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
        mean = vocabulary.agg(F.avg(_raw(n, F.col("df")))).first()[0]
        weights = {t: EPSILON * mean if raw < 0 else raw for t, raw in weights.items()}
    parts = [_part(F.lit(raw * wanted.count(t)), _times(F.col(held), t), F.size(held), F.lit(avgdl)) for t, raw in weights.items()]
    return docs.withColumn(held, tokens(F.coalesce(text, F.lit("")))).withColumn(out, sum(parts[1:], parts[0])).drop(held)


def piece_scores(pieces: Sequence[str], wanted: Sequence[str]) -> list[float]:
    """BM25 of each text of a list, the list being the corpus."""
    words = [re.findall("[a-z0-9]+", p.lower()) for p in pieces]
    n, avgdl = len(words), sum(map(len, words)) / max(len(words), 1)
    counts = [Counter(w) for w in words]
    raw = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    asked = {t: df for t in dict.fromkeys(wanted) if (df := sum(t in c for c in counts))}
    weights = {t: raw(df) for t, df in asked.items()}
    if any(w < 0 for w in weights.values()):
        dfs = Counter(t for c in counts for t in c)
        mean = math.fsum(map(raw, dfs.values())) / len(dfs)
        weights = {t: EPSILON * mean if w < 0 else w for t, w in weights.items()}
    return [
        sum(w * wanted.count(t) * c[t] * (K1 + 1) / (c[t] + K1 * (1 - B + B * len(ws) / avgdl)) for t, w in weights.items() if t in c)
        for c, ws in zip(counts, words, strict=True)
    ]


def bm25_of_pieces(pieces: Column, query: str) -> Column:
    """An array of scores beside an array of texts, null beside null: each row is a corpus of its own.

    A corpus per row has no JVM form short of nested lambdas, which Catalyst repeats at every use, so this runs
    in Arrow batches; being marked as not deterministic it is never repeated, nor is a filter pushed into it.
    """
    import pandas as pd

    wanted = query_tokens(query)

    def score(column):
        return pd.Series([None if x is None else [float(s) for s in piece_scores(list(x), wanted)] for x in column], dtype=object)

    return F.pandas_udf(score, "array<double>").asNondeterministic()(pieces)


def dead_terms(docs: DataFrame, text: Column | str, query: str) -> DataFrame:
    """``position, term`` of the distinct query words that no document holds, in query order."""
    spark, wanted = docs.sparkSession, list(dict.fromkeys(query_tokens(query)))
    asked = spark.createDataFrame(list(enumerate(wanted)), "position int, term string")
    text = F.col(text) if isinstance(text, str) else text
    seen = docs.select(F.explode(F.array_distinct(tokens(text))).alias("term")).filter(F.col("term").isin(wanted)).distinct()
    return asked.join(seen, "term", "left_anti").select("position", "term")


def keyphrases(docs: DataFrame, columns: Sequence[Column | str], phrases: Sequence[str]) -> DataFrame:
    """``docs`` with ``hits`` and ``matched``: the phrases that stand in the row's text as whole words."""
    found = phrases_found(padded_text(*columns), phrases)
    return docs.withColumn("matched", found).withColumn("hits", F.size("matched"))


def zero_hits(scored: DataFrame, phrases: Sequence[str], matched: str = "matched") -> list[str]:
    """The phrases that no row holds, in the given order."""
    if not phrases:
        return []
    found = scored.agg(*[F.coalesce(F.bool_or(F.array_contains(matched, p)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(phrases)]).first()
    return [p for p, hit in zip(phrases, found, strict=True) if not hit]


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``value, n``: how many rows have each value, as of numbers of keyphrase hits."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``name, least, most`` of numeric columns, nulls passed over."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"lo{i}").alias("least"), F.col(f"hi{i}").alias("most")) for i, c in enumerate(columns)])
    return ends.select(F.inline(rows))


def scaled(column: Column, lo: float | None, hi: float | None) -> Column:
    """A column on [0, 1] between given ends; zeros where they are equal."""
    return (column - lo) / (hi - lo) if lo is not None and hi is not None and hi > lo else F.lit(0.0)


def combine(df: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Adds ``bm25_norm, sparse, dense_norm, score`` to rows of ``bm25, hits, dense``; a half without signal has no weight.

    One aggregate of a few rows (one for each number of hits, of which there are as many as phrases) gives
    the ends of every scale, also of the sum of scaled BM25 and hits; the rows are then scored where they lie.
    """
    ends = df.groupBy("hits").agg(F.min("bm25").alias("lo"), F.max("bm25").alias("hi"), F.min("dense").alias("dense_lo"), F.max("dense").alias("dense_hi")).collect()
    known = lambda name: [float(r[name]) for r in ends if r[name] is not None]
    lo, hi = min(known("lo"), default=None), max(known("hi"), default=None)
    dense_lo, dense_hi = min(known("dense_lo"), default=None), max(known("dense_hi"), default=None)
    norm = lambda x: (x - lo) / (hi - lo) if hi > lo else 0.0
    sums = [norm(float(r[x])) + r["hits"] for r in ends for x in ("lo", "hi") if r[x] is not None and r["hits"] is not None]
    both_lo, both_hi = min(sums, default=None), max(sums, default=None)
    df = df.withColumn("bm25_norm", scaled(F.col("bm25"), lo, hi))
    df = df.withColumn("sparse", scaled(F.col("bm25_norm") + F.col("hits"), both_lo, both_hi)).withColumn("dense_norm", scaled(F.col("dense"), dense_lo, dense_hi))
    live = [both_hi is not None and both_hi > both_lo, dense_hi is not None and dense_hi > dense_lo]
    if all(live):
        return df.withColumn("score", alpha * F.col("sparse") + (1 - alpha) * F.col("dense_norm"))
    return df.withColumn("score", F.col("sparse") if live[0] else F.col("dense_norm"))


def dense(df: DataFrame, vectors: Sequence[str], query: Sequence[float]) -> DataFrame:
    """``dense``: the mean over vector columns of the cosine with the query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sims = [cosine(v, q) for v in vectors]
    return df.withColumn("dense", sum(sims[1:], sims[0]) / len(sims))


def top_k(df: DataFrame, k: int, order: Sequence[Column], exclude: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """The first k rows, those of excluded ids passed over. Spark keeps k rows per task, so nothing is sorted as a whole."""
    if exclude is not None:
        df = df.join(exclude.select(on), on, "left_anti")
    return df.orderBy(*order).limit(k)


def draw_key(seed: int, id_col: str) -> Column:
    """A seeded order of ids that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def random_rows(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    return df.orderBy(draw_key(seed, id_col), id_col).limit(k)


def ranked(df: DataFrame, id_col: str) -> DataFrame:
    """``rank`` by falling score, ties by id, and ``run``: the number of the stretch of equal rounded scores.

    Both come from counts per rounded score (scores lie between 0 and 1, so a thousand at most) and a window within each.
    """
    value = fresh(df.columns, "__r")
    df = df.withColumn(value, F.bround("score", FLAT_DECIMALS))
    counts = df.groupBy(F.col(value).alias("__q")).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy(F.desc("__q"))
    counts = counts.withColumn("run", F.row_number().over(order) - 1).withColumn("__before", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(value).orderBy(F.desc("score"), id_col))
    joined = df.join(counts, F.col(value).eqNullSafe(F.col("__q")))
    return joined.withColumn("rank", F.col("__before") + inside).drop("__n", "__before", value, "__q")


def select_band(table: DataFrame, id_col: str, n: int, anchor: float, seed: int, taken: Sequence = ()) -> DataFrame:
    """n rows of a ranked table around an anchor: a seeded draw across the flat run there, then down from it, then up.

    Anchor and run are those of the whole ranking; rows of ``taken`` ids are passed over afterwards.
    """
    last = table.agg(F.max("rank")).first()[0]
    if last is None:
        return table.limit(0)
    start = round(anchor * (last - 1)) + 1
    run = table.filter(F.col("rank") == start).select("run").first()[0]
    flat = F.col("run") == run if table.filter(F.col("run") == run).limit(2).count() > 1 else F.lit(False)
    within = F.when(F.col("rank") >= start, F.col("rank")).otherwise(-F.col("rank"))
    order = [F.when(flat, 0).when(F.col("rank") >= start, 1).otherwise(2), F.when(flat, draw_key(seed, id_col)), F.when(~flat, within), F.col(id_col)]
    left = table.filter(~F.col(id_col).isin(list(taken))) if len(taken) else table
    return left.orderBy(*order).limit(n)


def gradient_subset(df: DataFrame, id_col: str, m: int, seed: int) -> DataFrame:
    """``band`` and the rows of a gradient draw; each band passes over rows that an earlier one took.

    The ranking is made once and kept while the bands, m rows in all, are read off.
    """
    from pyspark.sql import types as T

    table, rows = ranked(df, id_col).persist(), []
    taken: list = []
    for band, n, anchor in gradient_bands(m):
        got = select_band(table, id_col, n, anchor, seed, taken).collect() if n else []
        taken += [r[id_col] for r in got]
        rows += [(band, *r) for r in got]
    out = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("band", T.StringType()), *table.schema.fields]))
    table.unpersist()
    return out


def band_summary(rows: DataFrame) -> DataFrame:
    """Per band: rows, and the least and greatest rank and score."""
    ends = [f(c).alias(f"{c}_{n}") for c in ("rank", "score") for n, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *ends)


def percentiles(df: DataFrame, column: str) -> DataFrame:
    """``p, value``: the tenth to the ninetieth percentile with linear interpolation, to six decimals."""
    exact = df.agg(F.percentile(column, F.array(*[F.lit(p) for p in PERCENTILES])).alias("v"))
    return exact.select(F.posexplode("v").alias("i", "v")).select(((F.col("i") + 1) * 10).cast("int").alias("p"), F.round("v", 6).alias("value"))
