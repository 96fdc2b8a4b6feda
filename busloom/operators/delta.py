"""DELTA: the gap since the last record with the same terminal, subaddress and direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

KEY = ("rt", "subaddress", "direction")


def with_delta(df: DataFrame, scope: str = "per-file", order: tuple[str, ...] = ("seq",), kinds: bool = False) -> DataFrame:
    """df with delta_us (long) and delta (seconds): 0 for a key's first record, null when time steps back or isn't known.

    Records without a time or without a key take no part; the others move the key's clock, also on a step back.
    kinds=True adds delta_kind: first, elapsed, backward, uncalibrated or no-key.
    """
    if scope not in ("per-file", "global"):
        raise ValueError(f"delta scope: {scope!r}")
    if scope == "per-file" and order == ("seq",) and "prev_us" in df.columns:
        df = df.withColumnRenamed("prev_us", "__prev")  # the source has told it
    elif order[0] == "merge_us" and scope == "global":
        df = blocks.last_known(df, "time_us", "__prev", [*KEY], list(order))
    else:
        by = KEY if scope == "global" else ("file_index", *KEY)
        # records without a key spread over their own order; they'd be one hot group else
        w = Window.partitionBy(*by, F.when(F.col("rt").isNull(), F.xxhash64(*order))).orderBy(*order)
        df = df.withColumn("__prev", F.last("time_us", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    now = F.col("time_us")
    known = F.col("rt").isNotNull() & now.isNotNull()
    prev = F.col("__prev")
    us = F.when(known & prev.isNull(), F.lit(0).cast("long")).when(known & (now >= prev), now - prev)
    df = df.withColumn("delta_us", us).withColumn("delta", F.col("delta_us") / 1e6)
    if kinds:
        kind = F.when(F.col("rt").isNull(), "no-key").when(now.isNull(), "uncalibrated").when(prev.isNull(), "first").when(now >= prev, "elapsed").otherwise("backward")
        df = df.withColumn("delta_kind", kind)
    return df.drop("__prev")


def backward_steps(df: DataFrame, scope: str = "per-file", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The first step back of each key: what there is to warn about, once."""
    marked = with_delta(df, scope, order, kinds=True).filter("delta_kind = 'backward'")
    by = KEY if scope == "global" else ("file_index", *KEY)
    return marked.groupBy(*by).agg(F.min_by("time_us", F.struct(*order)).alias("time_us"), F.count("*").alias("steps"))
