"""Documents to training tokens: quality, exact and near duplicates, source mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, classifier, exact_dedup, mixing, near_dup
from ledgerlens.session import written


def _small_batches(spark: SparkSession) -> None:
    """Texts are long: a thousand of them at a time, not Spark's ten thousand, keep the executors' memory small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels outside its held-out fifth."""
    _small_batches(spark)
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the longest, then smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a shingle similarity of 0.8 or more the smallest id."""
    _small_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them, whole."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text: doc_id, source, n_tokens, token_ids."""
    _small_batches(spark)
    done = bpe.encode_column(docs.select("doc_id", "source", "text"), out="t", offsets=False)
    return done.select("doc_id", "source", F.size("t.ids").cast("long").alias("n_tokens"), F.col("t.ids").alias("token_ids"))


STAGES = [
    ("quality", quality), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("encode", encode)]

ORACLE_SQL = None  # learnt scores, MinHash and tokenizer ids cannot be expressed in SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
