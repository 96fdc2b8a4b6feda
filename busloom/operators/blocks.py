"""Looking back over merged records without holding a key in one task.

A window by key is one task for each key, and over a merge one key may hold most records. Here rows are cut into blocks of
time; a window works inside a block, and what it needs of the blocks before comes from one row for each key and block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a merge in one block.
SPAN_US = 60_000_000


def last_known(df: DataFrame, column: str, out: str, by: list[str], order: list[str]) -> DataFrame:
    """df (merged) with out: the last value of a column that isn't null before a row, among rows with its keys.

    Rows with a null key are dealt out by their order and get null.
    """
    cut = df.withColumn("__block", F.coalesce(F.floor(F.col("merge_us") / SPAN_US), F.lit(-1).cast("long")))
    heads = cut.groupBy(*by, "__block").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("__last"))
    along = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.withColumn("__carried", F.last("__last", ignorenulls=True).over(along))
    carried = carried.select(*(F.col(k).alias(f"__j{i}") for i, k in enumerate([*by, "__block"])), "__carried")
    no_key = F.col(by[0]).isNull()
    same = F.col("__block") == F.col(f"__j{len(by)}")
    for i, k in enumerate(by):
        no_key = no_key | F.col(k).isNull()
        same = same & (F.col(k) == F.col(f"__j{i}"))
    w = Window.partitionBy(*by, "__block", F.when(no_key, F.xxhash64(*order))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("__inside", F.last(column, ignorenulls=True).over(w))
    both = inside.join(carried, same, "left").withColumn(out, F.when(~no_key, F.coalesce("__inside", "__carried")))
    return both.drop("__block", "__inside", "__carried", *(f"__j{i}" for i in range(len(by) + 1)))
