"""The corpus pipeline: quality rules, toxicity, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. `run` writes each stage's rows as Parquet into the shared checkpoint folder and reads them
again for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import jaccard_join, packing, quality_rules, toxicity
from quern.operators.staging import shared_folder

#: Near copies: word n-grams of this length, with this similarity in percent or more.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the text rules and their host's verdict keep."""
    return quality_rules.host_rules(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on the allowed labels of those that came, doesn't score as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.not_toxic(docs, toxicity.train(docs, labels, toxicity.trainable))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return jaccard_join.one_of_each(docs, n=SHINGLE_WORDS, percent=SIMILARITY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in sequences."""
    return packing.pack(docs, ["doc_id"], keep_ids=False)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", packed)]

#: Tokenizing and the stages' models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
