"""The corpus pipeline: documents in, packed training sequences out, one written table after every stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import exact_dedup, packing, quality, simhash, source_mix
from cohortloom.llm.common import table
from cohortloom.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; a source is a host, a language within it a path."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose SimHashes of three-word shingles are linked at two differing bits or fewer."""
    return simhash.without_near_copies(docs, width=3)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return source_mix.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1,024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

# Classifier fits, token merges and the packing plan are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
