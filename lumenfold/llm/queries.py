"""One query for each corpus operator: thin, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import embedding_dedup, fingerprints, group_ranking, line_dedup, mixing, ngram_jaccard, packing, quality_rules, quotations, secret_scan, token_counts, toxicity, vector_codes
from lumenfold.llm.tokenizers_path import default_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.shingle_components(_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op5_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.linked(_table(spark, sf_dir, "conversations"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.merged(_table(spark, sf_dir, "documents"), default_path("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"), whole=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))


def op11_group_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_ranking.ranked_lines(_table(spark, sf_dir, "sale_lines"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.SQL, "op5_chat_quotations": quotations.SQL, "op7_line_dedup": line_dedup.SQL, "op9_embedding_dedup": embedding_dedup.SQL, "op11_group_ranking": group_ranking.SQL, "op12_vector_codes": vector_codes.SQL}
