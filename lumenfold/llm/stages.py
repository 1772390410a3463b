"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each by one operator.

For all of them: a null text is empty, an empty table gives an empty table, null and repeated ids and rows are rows like others,
texts of any length are worked on whole, extra columns of ``docs`` go, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import mixing, ngram_jaccard, packing, secret_scan, toxicity
from lumenfold.llm.tokenizers_path import default_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go.

    Empty texts get the score of the bias and go or stay together; equal texts do too, whatever their ids; without labels of both
    classes all stay, or all go if every label is toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keep = toxicity.filtered(docs.select(*COLUMNS), labels)
    return keep.select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents one row stays: that of the smallest id that isn't null, then of the smallest key.

    Rows are told apart by id and text, so null and repeated ids lose no other text; of rows equal in both the least one stays.
    Rows without words are in no class and all stay. Of rows that are equal in id and text but not in other columns the least by all stays.
    """
    classes = ngram_jaccard.shingle_classes(docs).where("component is not null")
    first = classes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")).select(F.col("first.rid").alias("rid"))
    counts = classes.groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    stays = counts.join(first.withColumn("stays", F.lit(True)), "rid", "left")
    told = stays.where("stays is null or n > 1").select(F.col("rid").alias("r"), F.coalesce("stays", F.lit(False)).alias("repeats"))
    docs = docs.select(*COLUMNS).withColumn("rid", ngram_jaccard.row_key())
    docs = docs.join(told, F.col("rid") == F.col("r"), "left")
    one = docs.where("repeats").groupBy("rid").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return docs.where("repeats is null").select(*COLUMNS).union(one)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by a mark of its kind, overlapping ones by one mark; documents without any, null texts too, stay as they are."""
    found = secret_scan.redacted(docs.select(*COLUMNS).withColumn("was", F.col("text")))
    changed = F.col("text") != F.col("was")
    return found.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each pass over a document, a last partial one cut after a word.

    Documents without words are never taken, and so go; a null source is a source; equal rows take the plans of their key in turn.
    """
    return mixing.mixture(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens, by sequence; an empty text is its end mark alone; equal rows are packed each for itself."""
    return packing.packed(docs, default_path("byte_bpe_50k.json"))
