"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Method. Within a block of rows, each dimension's values are sorted, to be read from the top by queries of
positive weight there and from the bottom by those of negative weight. Sorted access goes down all lists
of a block in step, a stretch of depths at a time, for all queries of a block of queries: rows first seen
in a stretch are scored in full, and a query stops when no unseen row can beat its k-th score, the bound
being the sum over dimensions of its weight times the value last read on its side. Blocks start from
nothing, and the k best of all blocks are merged, so results are exact, ties included.

Scale. Rows and queries are cut into blocks of fixed size by hash, and every pair of blocks is one small
unit of work in a task: no task holds more than a block of each, and the stated query set meets all rows.
A pair of blocks returns k rows per query at most, merged by a grouped maximum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parts_for, read_table, shuffle_partitions

K, SCALE, EVERY = 5, 256, 50
ROWS_IN_BLOCK, QUERIES_IN_BLOCK = 16384, 4096
#: Depths of sorted access per stretch.
STRETCH = 64


def threshold_algorithm(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row id, score) of each query's k best rows other than its own, ties to smaller ids."""
    n, dims = rows.shape
    by_id = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[by_id], row_ids[by_id]
    order = np.argsort(rows, axis=0, kind="stable")  # the sorted lists, ascending
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    first_seen = np.minimum(place, n - 1 - place).min(axis=1)  # the depth at which sorted access meets a row
    turn = np.argsort(first_seen, kind="stable")
    cuts = np.searchsorted(first_seen[turn], np.arange(0, n + STRETCH, STRETCH))
    values = np.take_along_axis(rows, order, axis=0)
    active = np.arange(len(queries))
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    best_score = np.full((len(queries), k), -np.inf)
    best_row = np.full((len(queries), k), n)
    for step in range(len(cuts) - 1):
        seen = np.sort(turn[cuts[step] : cuts[step + 1]])
        if len(seen):
            scores = queries[active] @ rows[seen].T
            scores[query_ids[active][:, None] == row_ids[seen][None, :]] = -np.inf
            kept = min(k, len(seen))
            # a stable order by falling score keeps ids ascending among equals
            all_scores = np.concatenate([best_score[active], scores], axis=1)
            all_rows = np.concatenate([best_row[active], np.broadcast_to(seen, scores.shape)], axis=1)
            if kept < scores.shape[1]:
                bar = -np.partition(-all_scores, k - 1, axis=1)[:, k - 1]
                width = int((all_scores >= bar[:, None]).sum(axis=1).max())
                some = np.argsort(-all_scores, axis=1, kind="stable")[:, : max(width, k)]
                all_scores, all_rows = np.take_along_axis(all_scores, some, 1), np.take_along_axis(all_rows, some, 1)
            for j, (s, r) in enumerate(zip(all_scores, all_rows, strict=True)):
                top = np.lexsort((r, -s))[:k]
                best_score[active[j], : len(top)], best_row[active[j], : len(top)] = s[top], r[top]
        depth = min((step + 1) * STRETCH, n) - 1
        bound = positive[active] @ values[n - 1 - depth] + negative[active] @ values[depth]
        active = active[best_score[active, k - 1] <= bound]  # an equal score of a smaller id may still come
        if not len(active) or 2 * (depth + 1) >= n + 1:
            break
    q, c = np.nonzero(best_row < n)
    found = best_score[q, c] > -np.inf
    q, c = q[found], c[found]
    return q, row_ids[best_row[q, c]], best_score[q, c].astype(np.int64)


def _pair_of_blocks(k: int):
    def run(key, left, right):
        import pyarrow as pa

        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})

        def matrix(table):
            flat = table.column("q").combine_chunks()
            return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)

        ids, vecs = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        q, rows, scores = threshold_algorithm(matrix(left), ids, matrix(right), vecs, k)
        return pa.table({"query_id": ids[q], "vec_id": rows, "score": scores})

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors(vec_id, embedding)`` whose id is divisible by
    ``every`` its k highest integer inner products among all other rows, ties to smaller ids.

    Rows whose vector is null, empty or holds a null, NaN or infinite component take no part, nor do rows
    without an id. Vectors of another length have no product with a query, so each length is searched among its
    own rows. Products are formed in doubles, exact while their parts' sums stay below 2**53,
    as for components up to 10**5 in size. Exactly repeated rows count once, and rows of a query's own id are never its
    candidates. Fewer candidates give fewer rows; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda v: F.floor(SCALE * v).cast("long"))
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = materialize(vectors.filter(good).filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q")).distinct(), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n_queries:
        return empty
    rows = rows.withColumn("dims", F.size("q"))
    n_row_blocks, n_query_blocks = parts_for(n, ROWS_IN_BLOCK), parts_for(n_queries, QUERIES_IN_BLOCK)
    if n_row_blocks * n_query_blocks < shuffle_partitions(spark):
        n_row_blocks = max(n_row_blocks, min(shuffle_partitions(spark), parts_for(n, 1024)))
    block = lambda m, s: F.pmod(F.xxhash64(F.lit(s), "vec_id"), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "q", "dims", block(n_query_blocks, 1).alias("qb"), spread(n_row_blocks).alias("rb"))
    others = rows.select("vec_id", "q", "dims", block(n_row_blocks, 2).alias("rb"), spread(n_query_blocks).alias("qb"))
    found = queries.groupBy("dims", "qb", "rb").cogroup(others.groupBy("dims", "qb", "rb")).applyInArrow(_pair_of_blocks(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
