"""The corpus pipeline: its stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import stages
from lumenfold.llm.common import written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard", stages.keep_one_of_near_copies),
    ("secret_scan", stages.redact_secrets),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack),
]

#: A trained classifier, similarity classes and tokenizer ids can't be written in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; between stages the rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
