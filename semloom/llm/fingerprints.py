"""Document fingerprints: threshold-scaled sketches of shingle hashes.

Method. A fingerprint keeps every hash of a text's five-word shingles that lies below a fixed fraction of
the hash range, and the least hash in any case. The threshold is the same for all texts, so sketches of
parts merge by union into the sketch of the whole, and sketches of very unequal texts compare fairly:
the hashes of both below the threshold are a uniform sample of both sets, from which containment and
Jaccard similarity are read off.

Scale. The next document in order of doc_id is found without a global sort in one task: texts are dealt
once into ranges of doc_id, cut at quantiles of the ids, and the first rows of each range go to the range
before it as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, read_table, shuffle_partitions
from .textvec import shingle_sets, texts

#: One shingle in FRACTION is kept.
FRACTION = 4
_BELOW = np.uint64((1 << 64) // FRACTION - 1)


def sketch(members: np.ndarray) -> np.ndarray:
    """The kept hashes of a sorted shingle set."""
    return members[: max(int(np.searchsorted(members, _BELOW, "right")), min(1, len(members)))]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts together: the kept hashes of either (a lone least hash above the threshold gives way)."""
    both = np.union1d(a, b)
    return both[: max(int(np.searchsorted(both, _BELOW, "right")), min(1, len(both)))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second holds; 1 for an empty first sketch."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def sketches(values: list[str]) -> list[np.ndarray]:
    import pyarrow as pa

    out: list[np.ndarray] = []
    column = texts(pa.array(values, pa.string()))
    for lo, hi in by_bytes(column, 1 << 19):
        out += [sketch(s) for s in shingle_sets(column.slice(lo, hi - lo))]
    return out


def as_text(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"


def _compare(rows: list[tuple[int | None, str]], following: list[str]):
    import pyarrow as pa

    own = [t for _, t in rows]
    changed = [edited(t, f) for t, f in zip(own, following, strict=True)]
    a, b, c = sketches(own), sketches(changed), sketches(following)
    columns = [
        pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([as_text(x) for x in a]), pa.array([as_text(x) for x in b]),
        pa.array([likeness(x, y) for x, y in zip(a, b)]), pa.array([likeness(x, y) for x, y in zip(a, c)]),
        pa.array([containment(x, y) for x, y in zip(a, b)]), pa.array([containment(x, y) for x, y in zip(a, c)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _in_order(batches):
    """Rows of sorted ranges (range, doc_id, text, whether it is of this range): each with its successor."""
    held: list[tuple[int, int | None, str, bool]] = []
    size = 0

    def flush(final: bool):
        nonlocal held, size
        rows, following = [], []
        for x, y in zip(held, held[1:] if not final else [*held[1:], held[-1]]):
            if x[3]:
                rows.append((x[1], x[2]))
                following.append(y[2] if y[0] == x[0] else x[2])
        held, size = held[-1:], 0
        return rows, following

    for batch in batches:
        for r, i, t, mine in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            held.append((r, i, t, mine))
            size += len(t)
            if size > 1 << 20:
                rows, following = flush(False)
                if rows:
                    yield _compare(rows, following)
    if held:
        rows, following = flush(True)
        if rows:
            yield _compare(rows, following)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of ``docs(doc_id, text)`` and of its edited text, and how alike they are.

    The edited text ends in the beginning of the next document by doc_id (after the last the first; of one
    document itself). ``near_*`` are estimated Jaccard similarities, ``in_*`` the estimated share of the
    text's shingles that the other holds. Null texts count as empty; a text without words has an empty
    fingerprint, and two of them have likeness 1. Rows of one doc_id, null (first of all) included, follow
    each other by text. Texts are taken whole; an empty table gives an empty one; other columns are not
    looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    quantiles = F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10000)
    cuts = sorted(set(docs.agg(quantiles).first()[0] or []))

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(np.array(cuts, np.int64), ids.fillna(0).to_numpy(np.int64), "right"))).astype("int32")

    placed = docs.withColumn("r", range_of("doc_id"))
    low = -(1 << 63)
    heads = sorted((r, low if first is None or nulls else first) for r, first, nulls in docs.select("doc_id").withColumn("r", range_of("doc_id")).groupBy("r").agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).collect())
    if not heads:
        return spark.createDataFrame([], _SCHEMA)
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}  # the first range's head goes after the last
    wrap = heads[0][1]
    key = F.coalesce("doc_id", F.lit(low))
    lookup = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    is_head = key.isin(list(before))
    mine = placed.select("r", "doc_id", "text", F.lit(True).alias("mine"), F.lit(0).alias("late"))
    guests = placed.filter(is_head).groupBy("doc_id").agg(F.min("text").alias("text")).select(lookup[key].alias("r"), "doc_id", "text", F.lit(False).alias("mine"), (key == wrap).cast("int").alias("late"))
    dealt = mine.unionByName(guests).repartitionById(parts, "r").sortWithinPartitions("r", "late", F.col("doc_id").asc_nulls_first(), F.desc("mine"), "text")
    return dealt.select("r", "doc_id", "text", "mine").mapInArrow(_in_order, _SCHEMA)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
