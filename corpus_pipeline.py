"""A corpus pipeline of five operators: each stage reads what its predecessor wrote.

STAGES: (name, function (spark, docs, sf_dir) -> DataFrame). run() applies them to documents and
writes each stage's rows as Parquet under the shared checkpoint folder; what a stage has read is
deleted once its own rows are written, so that one stage's rows are on disk in the end.

Defined results: what each operator defines for nulls, empty texts and repeated rows holds here; an
empty table gives an empty result; columns beyond those of documents pass through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import cotraining, decontaminate, exact_dedup, jaccard_join, mixing
from sievework.llm.common import ready
from sievework.llm.queries import MIX, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, MIX)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
]

#: SQL cannot express the classifier and the latent search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the last stage takes."""
    ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            files.delete(path(f"{folder}/{i - 1}"), True)
    return docs
