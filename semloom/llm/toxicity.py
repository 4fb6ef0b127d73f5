"""Toxicity scores by non-negative positive-unlabelled learning.

Method. Confirmed toxic examples are the positive sample; a sample of all text, whatever its label, is
the unlabelled one. A linear model in numpy minimizes the class-prior-corrected risk
``p R+(positive) + max(0, R-(unlabelled) - p R-(positive))`` with logistic losses; where the second term
falls below zero, its gradient is reversed, so the model cannot overfit the positives. Inputs are the
words of a text and the beginnings of its words, as presence; nothing but the text is an input.

Bounds. The classifier is fitted on at most ``max_positive`` confirmed examples and ``max_unlabelled``
texts, chosen by the order of a seeded hash of doc_id over all rows, with at most ``max_features`` weights.
How common a feature is gets counted over all texts outside the held-out fold, and every text is scored
whole. Only these samples, one count for each feature of the positives, and scalars reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, collected, lean, read_table
from .textvec import ALNUM, U, mix, texts, words

#: Lengths in bytes of the word beginnings that count as features beside whole words.
BEGINNINGS = (4, 5, 6)
FOLDS = 5


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def feature_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Of a string column: feature hashes and the number of the text each stands in."""
    w = words(column, ALNUM)
    owner, long = w.owner(), w.end - w.start
    values, owners = [w.hashes()], [owner]
    for k in BEGINNINGS:
        some = long > k
        values.append(mix(w.hash_spans(w.start[some], w.start[some] + k) + U(k)))
        owners.append(owner[some])
    return np.concatenate(values), np.concatenate(owners)


class Lookup:
    """Positions of hashes in a sorted table; a bitmap of low bits answers most of the absent ones."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(table & U((1 << 18) - 1)).astype(np.int64)] = True

    def find(self, values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, position) of the values in the table, each pair once, ordered."""
        some = self.bits[(values & U((1 << 18) - 1)).astype(np.int64)]
        values, owners = values[some], owners[some]
        if not len(self.table):
            return owners[:0], owners[:0]
        at = np.minimum(np.searchsorted(self.table, values), len(self.table) - 1)
        hit = self.table[at] == values
        pairs = np.unique(owners[hit] * len(self.table) + at[hit])
        return pairs // len(self.table), pairs % len(self.table)


def _present(table: np.ndarray | None):
    """Rows of the features a text has: as hashes, or as positions in a table."""

    def run(batches):
        import pyarrow as pa

        find = Lookup(table) if table is not None else None
        for batch in batches:
            column = texts(batch.column(0))
            for lo, hi in by_bytes(column, 1 << 19):
                values, owners = feature_hashes(column.slice(lo, hi - lo))
                if find is None:
                    order = np.lexsort((values, owners))
                    values, owners = values[order].view(np.int64), owners[order]
                    first = np.ones(len(values), bool)
                    first[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
                    values, owners = values[first], owners[first]
                else:
                    owners, values = find.find(values, owners)
                cut = np.searchsorted(owners, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int64()))], names=["f"])

    return run


def _sampled(docs: DataFrame, ids: DataFrame, table: np.ndarray | None) -> list[np.ndarray]:
    """Features of the texts whose ids are in a table of bounded size; of a repeated id the least text."""
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select("text").mapInArrow(lean(_present(table)), "f array<long>")
    lists = [x for x in collected(rows)["f"].chunks if len(x)]
    return [f for x in lists for f in np.split(x.flatten().to_numpy(), x.offsets.to_numpy()[1:-1] - x.offsets[0].as_py())]


def _counted(table: np.ndarray):
    """Rows (position, texts that hold it) for the features of a table, and (-1, texts), summed over a task."""

    def run(batches):
        import pyarrow as pa

        find, counts, seen = Lookup(table), np.zeros(len(table), np.int64), 0
        for batch in batches:
            column = texts(batch.column(0))
            for lo, hi in by_bytes(column, 1 << 19):
                counts += np.bincount(find.find(*feature_hashes(column.slice(lo, hi - lo)))[1], minlength=len(table))
            seen += len(column)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], seen))], names=["at", "n"])

    return run


def commonness(docs: DataFrame, table: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs(text)`` each feature of the table stands, and how many texts there are."""
    rows = docs.select("text").mapInArrow(lean(_counted(table)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    rows, counts = collected(rows), np.zeros(len(table) + 1, np.int64)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()  # -1: the last
    return counts[:-1], int(counts[-1])


def nnpu(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimize the non-negative PU risk of a linear model with logistic loss."""
    n, features = len(x_p), x_p.shape[1]
    theta = np.zeros(features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        s_p, s_u = sigmoid(x_p @ theta[:-1] + theta[-1]), sigmoid(x_u @ theta[:-1] + theta[-1])
        grad = lambda x, d: np.append(x.T @ d, d.sum()) / len(x)
        negative = -np.log(1 - s_u + 1e-12).mean() + prior * np.log(1 - s_p + 1e-12).mean()
        g_negative = grad(x_u, s_u) - prior * grad(x_p, s_p)
        g = prior * grad(x_p, s_p - 1) + g_negative if negative >= 0 else -g_negative
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # features speak for toxicity or not at all
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, positive: DataFrame, labelled: int, max_positive: int = 3000, max_unlabelled: int = 6000, max_features: int = 512, seed: int = 11) -> Model | None:
    """Fit on ``docs(doc_id, text)`` given the ids of confirmed toxic ones; None if either sample is empty.

    ``labelled`` is the number of labelled rows the positives come from: their share is the class prior.
    """
    draw = F.xxhash64(F.lit(seed), "doc_id")
    n_positive = positive.count()
    if not n_positive:
        return None
    chosen = positive.orderBy(draw, "doc_id").limit(max_positive)
    p = _sampled(docs, chosen, None)
    if not p:
        return None
    values, df_p = np.unique(np.concatenate(p).view(U), return_counts=True)
    least = max(3, int(0.004 * len(p)))
    values, df_p = values[df_p >= least], df_p[df_p >= least]
    if not len(values):
        return None
    df_u, n_u = commonness(docs, values)
    share_p, share_u = (df_p + 0.5) / (len(p) + 1), (df_u + 0.5) / (n_u + 1)
    expected = len(p) * share_u
    # Chernoff bound of the chance that so many positives hold the feature by accident, over all features tried
    evidence = np.where(df_p > expected, df_p * np.log(df_p / expected) - df_p + expected, 0.0)
    prior = min(0.5, max(0.01, n_positive / max(labelled, n_positive)))
    # a feature of toxic texts alone stands in a share of prior * share_p of the unlabelled ones
    good = np.flatnonzero((share_p > max(2.0, min(0.6 / prior, 6.0)) * share_u) & (evidence > np.log(len(values) / 0.05)))
    good = np.sort(good[np.argsort(-evidence[good], kind="stable")][:max_features])
    if not len(good):
        return None
    features = values[good]
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(draw, "doc_id").limit(max_unlabelled)
    u = _sampled(docs, ids, features)

    def matrix(rows):
        x = np.zeros((len(rows), len(features)), np.float32)
        for i, r in enumerate(rows):
            x[i, r] = 1
        return x

    at = [np.minimum(np.searchsorted(features, h), len(features) - 1) for h in (r.view(U) for r in p)]
    p_rows = [k[features[k] == r.view(U)] for k, r in zip(at, p, strict=True)]
    weights, bias = nnpu(matrix(p_rows), matrix(u), prior)
    return Model(features, weights, bias)


def scores(model: Model | None, column) -> np.ndarray:
    """A score for each text of a string column without nulls; 0 without a model."""
    if model is None:
        return np.zeros(len(column))
    owners, at = Lookup(model.features).find(*feature_hashes(column))
    z = np.bincount(owners, model.weights[at], len(column)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scored(model: Model | None):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = texts(batch.column(1))
            for lo, hi in by_bytes(column, 1 << 19):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(scores(model, column.slice(lo, hi - lo)))], names=["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the rows outside the held-out fold: those whose crc32 of doc_id as text mod 5 is not 0."""
    outside = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS != 0
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(outside & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return fit(docs.filter(outside), known.filter("toxic = 1").select("doc_id"), known.count())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have no features and get the lowest score the model gives. Repeated rows get
    equal scores. Labels that are null are not looked at; a doc_id labelled both ways counts as toxic. If
    there is no confirmed toxic example outside the held-out fold, all scores are 0. A null doc_id counts
    as held out. Empty tables give an empty one; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = docs.mapInArrow(lean(_scored(train(docs, labels))), "doc_id long, score double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model calls toxic go, all others stay as they are.

    The text alone decides, so a row is kept or dropped in place; no shuffle.
    """
    model = train(docs, read_table(spark, sf_dir, "labels"))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = texts(batch.column(at).cast(pa.string()))
            for lo, hi in by_bytes(column, 1 << 19):
                yield batch.slice(lo, hi - lo).filter(pa.array(scores(model, column.slice(lo, hi - lo)) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
