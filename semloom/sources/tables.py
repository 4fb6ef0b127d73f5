"""Sources: tables, subsets by id, images, JSON documents, directory listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_id


def in_memory(spark: SparkSession, rows, schema: T.StructType | str | None = None, source: str | None = None) -> DataFrame:
    """A table from rows or a pandas frame; ``source`` adds a provenance column ``_src`` of the name and the row's place."""
    df = spark.createDataFrame(rows, schema)
    if source is None:
        return df
    indexed = df.rdd.zipWithIndex().map(lambda x: (*x[0], f"{source}-{x[1]}"))  # small literal tables only
    return spark.createDataFrame(indexed, T.StructType([*df.schema.fields, T.StructField("_src", T.StringType())]))


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with a header; quoted cells may hold line breaks and doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def parquet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    return spark.read.parquet(path if name is None else f"{path}/{name}.parquet")


def parquet_of_ids(spark: SparkSession, path: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of the given ids only: a semi join, so the scan stays columnar and repeated ids add nothing."""
    return spark.read.parquet(path).join(ids.select(id_col), id_col, "left_semi")


def json_documents(spark: SparkSession, path: str, array: str | None = None) -> DataFrame:
    """Multi-line JSON; ``array`` names a list whose items become rows."""
    df = spark.read.option("multiLine", True).json(path)
    return df if array is None else df.select(F.explode(array).alias("item")).select("item.*")


def subset(dataset: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Dataset rows of a subset table, in the subset's order (column ``_pos``), of repeated ids the first row.

    ``ids`` has one column, in file order by ``_pos`` if present. An id that the dataset lacks is an error;
    a subset of several columns is a table of its own and returned as it is.
    """
    named = [c for c in ids.columns if c != "_pos"]
    if len(named) != 1:
        return ids
    wanted = ids if "_pos" in ids.columns else ids.withColumn("_pos", F.monotonically_increasing_id())
    wanted = wanted.select(normalize_id(named[0]).alias("__id"), "_pos").groupBy("__id").agg(F.min("_pos").alias("_pos"))
    keyed = dataset.withColumn("__id", normalize_id(id_col))
    missing = wanted.join(keyed.select("__id"), "__id", "left_anti")
    if lost := [r[0] for r in missing.limit(5).collect()]:
        raise ValueError(f"the dataset lacks ids of the subset: {lost}")
    rows = keyed.join(wanted, "__id")  # small subsets are broadcast by their measured size
    first = F.row_number().over(Window.partitionBy("__id").orderBy(*[F.col(f"`{c}`") for c in dataset.columns if not isinstance(dataset.schema[c].dataType, T.MapType)]))
    return rows.withColumn("__n", first).filter("__n = 1").drop("__n", "__id").orderBy("_pos")


def with_images(df: DataFrame, id_col: str, folder: str, column: str = "image") -> DataFrame:
    """A path column ``folder/id.jpg``, marked as an image in its metadata."""
    path = F.concat(F.lit(folder.rstrip("/") + "/"), normalize_id(id_col), F.lit(".jpg"))
    return df.withColumn(column, path).withMetadata(column, {"modality": "image"})


def with_image_bytes(df: DataFrame, column: str, folder: str) -> DataFrame:
    """The path column replaced by the images' bytes, still marked as images; null where there is no file."""
    found = image_bytes(df.sparkSession, folder).select(F.concat("id", F.lit(".jpg")).alias("__file"), F.col("content").alias("__bytes"))
    named = df.withColumn("__file", F.regexp_extract(F.col(f"`{column}`"), r"([^/]+)$", 1))
    joined = named.join(found, "__file", "left").drop("__file")
    return joined.withColumn(column, F.col("__bytes")).drop("__bytes").withMetadata(column, {"modality": "image"})


def explore(dataset: DataFrame, ids: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """The whole table for aggregates, or the rows of a subset."""
    return dataset if ids is None else subset(dataset, ids, id_col or dataset.columns[0])


def image_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select(F.regexp_extract("path", r"([^/]+)\.jpg$", 1).alias("id"), "path", "content")


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Sorted (name, kind) of a folder in any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((s.getPath().getName(), "dir" if s.isDirectory() else "file") for s in found)


def schema_lines(df: DataFrame) -> list[str]:
    return [f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields]


def sample_lines(df: DataFrame, n: int = 5, cell: int = 300, block: int = 4000) -> str:
    """The first n rows as text; cells and the whole are cut to length before they leave the executors."""
    cut = df.select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, cell).alias(c) for c in df.columns]).limit(n)
    return "\n".join(str(r.asDict()) for r in cut.collect())[:block]


def columns_only(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A view of a table that hides all other columns."""
    return df.select(*cols)
