"""Session helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
#: What operators keep in a worker for their next tasks, by operator.
_KEPT: dict[str, dict] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor sees.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session runs on one
    machine, as in tests, a temporary folder of this machine serves.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="semloom-")
        _ROOTS[app] = f"{base.rstrip('/')}/semloom-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended already: its folder goes with the cluster's own clean-up
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return held_at(spark.read.schema(df.schema).parquet(path), path)


def held_at(df: DataFrame, path: str | None) -> DataFrame:
    """Note the folder of the one intermediate table that a frame reads."""
    df.__dict__["_held_at"] = path
    return df


def place_of(df: DataFrame) -> str | None:
    return df.__dict__.get("_held_at")


def discard(df: DataFrame) -> None:
    """Delete an intermediate table that nothing will read again."""
    if path := place_of(df):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array holding about ``limit`` bytes each, one row at least."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else []
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(column):
        yield start, len(column)


def per_text(df: DataFrame, keep: list[str], schema: str, rows: Callable[[list[str]], Iterable[tuple]], chunk: int = 1 << 20, operator: str | None = None) -> DataFrame:
    """Apply ``rows`` to lists of whole texts (null: empty); its tuples stand beside the columns of ``keep``.

    ``rows`` runs once for each few megabytes of text, so a task never holds more than an Arrow batch and
    one such list, however long its partition is.
    """
    from pyspark.sql.types import StructType

    out_schema = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(schema).fields])
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def apply(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out_schema)
        for batch in batches:
            text = batch.column(len(keep))
            for lo, hi in by_bytes(text, chunk):
                texts = [t or "" for t in text.slice(lo, hi - lo).to_pylist()]
                made = list(zip(*rows(texts), strict=True)) or [()] * len(names)
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                cols = [c.cast(target.field(i).type) for i, c in enumerate(cols)]
                cols += [pa.array(v, type=target.field(len(keep) + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(cols, schema=target)

    return df.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(lean(apply, operator), out_schema)


def kept(operator: str) -> dict:
    """A table of an operator that lasts from task to task of a worker, until a task of another operator begins there."""
    return _KEPT.setdefault(operator, {})


def only_kept(operator: str | None) -> None:
    """Empty the tables of all other operators: workers are used again, so they would hold what every operator so far has kept."""
    others = [table for name, table in _KEPT.items() if name != operator and table]
    for table in others:
        table.clear()
    if others:
        gc.collect()  # what was kept may refer to itself


def release() -> None:
    """Give freed memory back to the system, which the allocators would hold for the life of the process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        return


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, in a worker that holds no more than a batch's work and what ``operator`` keeps there."""

    def each(batches):
        for batch in batches:
            yield batch
            del batch
            release()

    def task(batches):
        only_kept(operator)
        try:
            yield from run(each(batches))
        finally:
            release()

    return task


class Packed:
    """An array that goes to the workers compressed, as beside the array they hold the bytes it came in."""

    def __init__(self, array: np.ndarray | None):
        self.array = array

    def __getstate__(self):
        return ("", b"") if self.array is None else (self.array.dtype.str, zlib.compress(self.array.tobytes(), 1))

    def __setstate__(self, state):
        self.array = np.frombuffer(zlib.decompress(state[1]), state[0]) if state[0] else None


def collected(df: DataFrame) -> pa.Table:
    """The rows of a table of bounded size as Arrow columns; no row becomes an object in the driver."""
    return df.toArrow()


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))
