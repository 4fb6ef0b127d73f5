"""A corpus pipeline of five operators of ``semloom.llm``: clean, dedupe, redact, mix and encode.

Each stage takes what its predecessor kept, as Parquet in the shared folder, and all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semloom.llm.common import materialize, read_table
from semloom.llm.mixing import mix_stage
from semloom.llm.ngram_join import dedupe_stage
from semloom.llm.secrets import redact_stage
from semloom.llm.sentencepiece import encode_stage
from semloom.llm.toxicity import clean_stage

STAGES = [
    ("toxicity", clean_stage),
    ("ngram_jaccard_join", dedupe_stage),
    ("secret_scans", redact_stage),
    ("mix_sources", mix_stage),
    ("sentencepiece", encode_stage),
]

#: Trained and hashed stages have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
