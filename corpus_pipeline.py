"""A training corpus from the documents table, in five stages.

Each stage takes the documents that the stage before kept and its decisions take
effect; all but the last return the columns of documents. run() writes each stage's
rows as Parquet beside the checkpoints and reads them again for the next.

Stages: documents that fail the quality rules go; one document of each near-duplicate
group stays (five words, similarity 0.8); documents that overlap a benchmark item go;
sources are mixed to target weights, a document coming as often as the mix takes it, to
the nearest whole time; the rows are put into shards of equal bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenq.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from lumenq.llm.tables import documents, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.attach(docs, sharding.assign(docs))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The fitted model of the first stage and the similarity groups of the second are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: the columns of documents, shard and slot."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
