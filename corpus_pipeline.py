"""The corpus pipeline: documents -> language ID -> exact dedup -> SimHash
near-dedup -> mixing -> packing.

Each stage takes the rows that the one before it kept, and its decisions take
effect: a stage returns the rows that stay, with the columns of documents; the
last returns the packed pieces. Between the stages the rows are written as
Parquet to the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covenant.llm import exact_dedup, lang_id, mixing, packing, simhash
from covenant.llm.common import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return lang_id.identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.survivors(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to meet their source's target."""
    return mixing.repeated(docs)


def packing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences along the curve."""
    return packing.packed(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("source mix", source_mix),
    ("packing", packing_order),
]

#: compression sizes, hash components and token ids are beyond SQL; tests hold
#: the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch(spark, f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
