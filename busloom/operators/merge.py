"""Merging recordings by time.

Taking the earliest of the files' next records, again and again, gives the order of (running maximum of a file's time, file,
arrival): a record that is earlier than one before it in its file comes out right behind that one. So a merge is a window by
file and a range sort, and needs no loop over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BackwardStep, MergeIncompatible

ORDER = ("merge_us", "file_index", "seq")
#: Records of a file over which one task keeps the highest time.
SPAN = 1 << 18


def merged(df: DataFrame) -> DataFrame:
    """df with merge_us; (merge_us, file_index, seq) is the order of the merge. The source may have told it.

    Files are cut by SPAN records: the highest time inside a span is a window, that before it comes from one row for each span.
    """
    if "merge_us" in df.columns:
        return df
    cut = df.withColumn("__span", F.floor(F.col("seq") / SPAN))
    spans = cut.groupBy("file_index", "__span").agg(F.max("time_us").alias("__most"))
    before = F.max("__most").over(Window.partitionBy("file_index").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(F.col("file_index").alias("__f"), F.col("__span").alias("__s"), before.alias("__before"))
    inside = F.max("time_us").over(Window.partitionBy("file_index", "__span").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    both = cut.withColumn("__inside", inside).join(spans, (F.col("file_index") == F.col("__f")) & (F.col("__span") == F.col("__s")))
    return both.withColumn("merge_us", F.greatest("__inside", "__before")).drop("__span", "__inside", "__f", "__s", "__before")


def in_merge_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*ORDER)


def incompatible(df: DataFrame) -> DataFrame:
    """Files whose first record has no calendar time: a counter, or a clock that ran free."""
    first = df.groupBy("file_index").agg(F.min_by(F.struct("ts_format", "freerun"), "seq").alias("first"))
    return first.filter((F.col("first.ts_format") != "irig") | F.col("first.freerun")).select("file_index", F.col("first.ts_format").alias("ts_format"), F.col("first.freerun").alias("freerun"))


def check_mergeable(df: DataFrame) -> None:
    bad = incompatible(df).orderBy("file_index").limit(1).collect()
    if bad:
        raise MergeIncompatible(f"input {bad[0].file_index} starts {'with a free-running clock' if bad[0].freerun else 'with counter times'}")


def backward_files(df: DataFrame) -> DataFrame:
    """Steps back in time within a file: how many, and the first."""
    w = Window.partitionBy("file_index").orderBy("seq")
    now = F.coalesce("ticks", "time_us") if "ticks" in df.columns else F.col("time_us")
    back = df.withColumn("__now", now).withColumn("__prev", F.lag("__now").over(w)).filter(F.col("__now") < F.col("__prev"))
    return back.groupBy("file_index").agg(F.count("*").alias("steps"), F.min("seq").alias("first_seq"))


def check_monotone(df: DataFrame, strict: bool) -> bool:
    """Whether all files are in order of time; in strict mode a file that isn't is an error."""
    bad = backward_files(df).orderBy("file_index").limit(1).collect()
    if bad and strict:
        raise BackwardStep(f"input {bad[0].file_index} steps back in time at record {bad[0].first_seq}")
    return not bad
