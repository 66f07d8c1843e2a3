"""A training-data pipeline over ``documents``; every stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import stages
from ledgerloom.llm.textkit import discard, workspace

STAGES = [
    ("language_id", stages.keep_known_language),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("private_data", stages.redact_private_data),
    ("byte_bpe", stages.encode_tokens),
]

#: SQL can't express the trained language model, the alignment of disguised identifiers or BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet to the shared folder and reread; only the last one's table stays."""
    docs, before, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), "", workspace(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            discard(spark, before)
        before = path
    return docs
