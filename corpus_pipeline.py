"""A training corpus from documents, in stages that each write Parquet: toxicity, quality rules, near duplicates, benchmark passages, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rulewright.llm import decontaminate, packing, quality_rules, simhash, toxicity
from rulewright.llm.common import ensure_checkpoint_dir, table
from rulewright.llm.queries import tokenizer_path, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, toxicity_model(spark, docs, sf_dir))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), by_row=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Fitted models, XXH64 majorities and byte-BPE can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written in the shared checkpoint folder and read again.

    Each stage works on rows, whatever their ids: null and empty texts have no words and go with the quality rules,
    repeated rows go with near duplicates but for one, and rows that only share an id, or have none, stay apart. Extra
    columns stay until packing. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
