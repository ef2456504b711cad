"""From raw documents to packed sequences: language ID, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet in
the folder the cluster shares and read again for the next. The near-dedup stage takes the fingerprints and the distance
of its operator's contract: shingles of three words, two bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronopanel import ship
from chronopanel.llm import stages
from chronopanel.llm.common import documents, remove, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return stages.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return stages.drop_shared_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return stages.keep_one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return stages.take_mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return stages.pack_sequences(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Fitted language models and token ids are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; a stage's folder goes once the next one is written, the last one stays."""
    docs = documents(spark, sf_dir)
    folder, before = shared_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
