"""A training-corpus pipeline: five stages over the documents table, each by one operator of tesserae.llm.

quality      rejected documents go (Bradley-Terry classifier, learned from labels)
near_dups    one document of each SimHash component stays, the one with the smallest id
passages     passages that a document with a smaller id has are cut out; what is empty then goes
secrets      found secrets are replaced by a mark
packing      what is left is packed into sequences; returns the pieces
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import packing, passages, quality_model, secrets, simhash
from tesserae.llm.common import documents, labels, stored


def _recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, labels(spark, sf_dir))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(passages.removed(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dups", near_dups), ("passages", repeated_passages), ("secrets", secret_scan), ("packing", pack)]

#: No stage but the third can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; every stage is written as Parquet and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
