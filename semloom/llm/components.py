"""Connected components of a link table, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_at, lean, materialize, place_of


def _forest(batches):
    """A spanning forest of each task's links: no component is lost, and dense groups shrink before any shuffle."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for batch in batches:
        src, dst = [], []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                src.append(a)
                dst.append(b)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["a", "b"])
        if len(parent) > 2_000_000:  # bounded memory: later links of this task may be redundant, never missing
            parent.clear()


def connected_components(links: DataFrame) -> DataFrame:
    """Label every node of ``links(a, b)`` with the smallest node of its component: ``(node, root)``.

    Each round hooks every component to its smallest neighbour, follows those pointers to their ends by
    doubling, and contracts the links; the number of components that still have links falls by half at
    least in each round, so there are O(log n) rounds. Labels move by equi-joins and grouped minima only,
    and each round's tables are written to the shared folder, so lineage stays short. Self-links and
    repeated links do no harm; nodes without links do not appear; an empty table gives an empty one.
    """
    links = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(lean(_forest), "a long, b long"), "links")
    label = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "hook")
        moved = True
        while moved:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            further = materialize(hook.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("next"), "root"), "hook")
            moved = not further.filter("next <> root").isEmpty()
            discard(hook)
            hook = held_at(further.select("node", F.col("next").alias("root")), place_of(further))
        to_a = hook.select(F.col("node").alias("a"), F.col("root").alias("x"))
        to_b = hook.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = materialize(links.join(to_a, "a").join(to_b, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).mapInArrow(lean(_forest), "a long, b long"), "links")
        discard(links)
        links = left
        if label is None:
            label = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            new = materialize(label.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
            for used in (label, hook):
                discard(used)
            label = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if label is None else label
