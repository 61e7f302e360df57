"""A training corpus from documents, in five stages; each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import exact_dedup, lang_id, near_dedup, packing, substring_dedup
from shutterlake.session import ensure_checkpoint_dir, table

#: A document is rejected if its language is undetermined or less likely than this.
MIN_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. The classifier learns from the labelled documents among them."""
    told = lang_id.predict(docs, lang_id.train(docs))
    return told.filter((F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the document with the smallest id: SimHash links, and MinHash's further ones, at a similarity of 0.8 or more."""
    return near_dedup.drop_near_copies(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and runs of words that repeat from an earlier place; n_chars follows the text."""
    cut = substring_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece of a document."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("exact", exact), ("near", near), ("substring", substring), ("packing", packed)]

#: SQL can't express the classifier, the similarity join or the tokenizer; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
