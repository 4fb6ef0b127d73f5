"""Rows that are read twice, written once to the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` names it; only where that is unset and the session runs on one machine, a temporary folder serves."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="semloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = f"file://{own}"
        _FOLDERS[app] = f"{base.rstrip('/')}/semloom-kept-{app}"
    return _FOLDERS[app]


def keep(df: DataFrame) -> DataFrame:
    """The same rows, computed once: a lost executor or a second reader never runs what made them again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
