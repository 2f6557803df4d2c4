"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes the odd rows as its operator does. Null texts have no words: quality rules reject them, as texts of
fewer than ten words, and so empty ones. Null ids are ids of no other row: such rows pass line dedup and the near
join untouched and are judged by their text elsewhere. Very long texts are read whole. Repeated rows are judged alike by
quality rules, decontamination and encoding; the near join keeps one document of a group, with all rows of its id. Ties of
a group go to the smallest id, of a line to the largest. Empty tables give empty results. Other columns of documents stay
until the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, decontamination, line_dedup, near_join, quality
from tidewell.llm.common import keep

#: Quality verdicts and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_docs(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they repeat of others; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def near_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return near_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit) and digests of them and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select(
        "doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
