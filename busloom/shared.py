"""Rows kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import UsageError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new local folder where it is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="busloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession) -> str:
    """The same as a path that open() takes: of a folder that is mounted on all machines."""
    folder = shared_dir(spark)
    where = urlsplit(folder)
    if where.scheme not in ("", "file"):
        raise UsageError(f"{folder}: standard input and output need a shared folder that is mounted")
    return unquote(where.path) if where.scheme else folder


def fixed(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order, written once: what reads them again finds them so, whatever executors are lost."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ranged(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """df in sorted ranges of an order. Ranges come from a look at all rows; a shuffle before it keeps what makes the rows, and counts them, from running twice."""
    dealt = df.repartition(parts, *order).withColumn("__dealt", F.spark_partition_id())
    return dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
