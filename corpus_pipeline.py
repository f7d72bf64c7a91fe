"""Corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, benchmark decontamination, BPE.

Every stage works on all that the one before it kept, and its decisions take effect: documents in no known language
go, one document of each near-duplicate group stays, repeated passages are cut, documents with benchmark passages
go, and what is left is encoded. Stages return the columns of documents, the last one token ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm.bpe_codec import bpe_codec
from loomstone.llm.common import Scratch, documents
from loomstone.llm.stages import in_a_language, not_in_benchmark, one_of_each_group, without_repeats


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_a_language(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return not_in_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec(docs, with_ids=True).drop("decoded")


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("suffix_dedup", repeat_stage),
    ("decontamination", benchmark_stage),
    ("bpe_codec", token_stage),
]

#: Learned models and suffix arrays have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
