"""Usual questions about a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_rt(df: DataFrame) -> DataFrame:
    """Records and errored records by terminal."""
    return df.filter("rt is not null").groupBy("rt").agg(F.count("*").alias("messages"), F.sum(F.col("error").cast("long")).alias("errored"))


def top_messages(df: DataFrame, n: int = 3) -> DataFrame:
    """The n commonest messages; ties go to the smaller terminal and label."""
    counted = df.filter("rt is not null").groupBy("rt", "msg_label").agg(F.count("*").alias("messages"))
    return counted.orderBy(F.desc("messages"), "rt", "msg_label").limit(n)


def rates(df: DataFrame) -> DataFrame:
    """Records a second by terminal, over the time from its first to its last; null if that is none."""
    g = df.filter("rt is not null and time_us is not null").groupBy("rt").agg(F.count("*").alias("messages"), (F.max("time_us") - F.min("time_us")).alias("span_us"))
    return g.withColumn("per_second", F.col("messages") / F.nullif(F.col("span_us"), F.lit(0).cast("long")) * 1e6)


def median_gaps(df: DataFrame) -> DataFrame:
    """Records, errored ones and the median gap by message."""
    g = df.filter("rt is not null").groupBy("rt", "msg_label")
    return g.agg(F.count("*").alias("messages"), F.sum(F.col("error").cast("long")).alias("errored"), F.percentile("delta_us", F.lit(0.5)).alias("median_gap_us"))


def word_series(df: DataFrame, rt: int, subaddress: int, direction: int, word: int) -> DataFrame:
    """Time and the value of one data word of one message."""
    own = df.filter((F.col("rt") == rt) & (F.col("subaddress") == subaddress) & (F.col("direction") == direction))
    return own.select("file_index", "seq", "time_us", F.get("data_words", F.lit(word)).alias("value")).filter("value is not null")


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and the sum of terminals: a quick check that two runs agree."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.col("rt").cast("long")).alias("rt_sum"))
