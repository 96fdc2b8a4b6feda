"""The corpus pipeline: five operators, each on all that the one before has kept, written as Parquet between them.

Nulls: a document without text, id, source or language takes part like any other; without words it scores as clean, has
fingerprint zero, is no passage of the benchmark, and the mix never takes it. Repeated rows are documents of their own until the
near-dedup, which leaves one of each group (ties: the smallest id, then the smallest hash of the text). Very long texts are read whole.
Empty tables make empty stages, and without labels or a benchmark nothing is rejected for them. Extra columns are carried through
all stages; one with the name of a column that sharding makes gives way to it in the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from busloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from busloom.llm.common import own_files, remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The classifier learns from the labelled ones among docs."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: that with the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; one that is taken in part comes if at least half is, or if it
    is the first of its source."""
    return mixing.apply(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with shard, slot and what else the operator tells.

    The mix has written its files in training order, which has no column of its own: slots follow the files and their rows.
    """
    return sharding.shard(docs, keep=tuple(docs.columns), in_file_order=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: Neither the classifier nor the components can be told in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has read, and its checkpoints, go as soon as its output is written; all goes if a stage fails."""
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for i, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{i}-{name}"
            with own_files(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    except BaseException:
        remove(spark, folder)
        raise
    return docs
