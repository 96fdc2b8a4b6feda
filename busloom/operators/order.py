"""Canonical order of records with one time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import fixed, ranged

MAX_GROUP = 65_536
#: Microseconds (or ticks) of a bucket of times.
BUCKET = 1_000_000


def order_rows(df: DataFrame, max_group: int = MAX_GROUP, position: tuple[str, ...] = ("seq",), by: tuple[str, ...] = (), monotone: bool = False) -> DataFrame:
    """df with order_run, order_segment, order_key, order_chunk: sorting by them and position gives the canonical order.

    Records of one run of equal times are sorted by terminal, subaddress and direction. A record without a command word
    travels with the one before it; such records that open a run come first. A run that is closed by such a record at
    another time stays in arrival order, if sorting would move its last chunk. Runs are cut into segments of max_group rows;
    a full segment stays in arrival order, and max_group=1 turns sorting off.

    With monotone=True (time never steps back along position) rows are cut into buckets of time, and a run is a time. All windows are
    inside a bucket; what opens the next one comes from one row for each bucket. Else rows are cut into ranges of their order, and runs are counted by
    a scan over these: inside each range first, then from a row for each range.
    """
    if not 1 <= max_group <= 1 << 20:
        raise ValueError("max_group: 1 to 1048576")
    by = tuple(by)
    key = F.when(F.col("rt").isNotNull(), F.col("rt") * 64 + F.col("subaddress") * 2 + F.col("direction"))
    stamp = F.struct(F.col("time_us"), F.col("ticks")) if "ticks" in df.columns else F.struct(F.col("time_us"))
    d = df.withColumn("__k", key).withColumn("__ts", stamp)
    where = F.struct(*position)
    if monotone:
        d = d.withColumn("__bucket", F.coalesce(F.floor(F.col("__ts.time_us") / BUCKET), *([F.floor(F.col("__ts.ticks") / BUCKET)] if "ticks" in df.columns else []), F.lit(0)))
        heads = d.groupBy(*by, "__bucket").agg(F.min_by(F.col("__k").isNull(), where).alias("__free"), F.min(where).alias("__first"))
        after = F.lead("__free").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__first"))
        heads = heads.select(*(F.col(c).alias(f"__h{i}") for i, c in enumerate([*by, "__bucket"])), F.coalesce(after, F.lit(False)).alias("__after"))
        cond = F.lit(True)
        for i, c in enumerate([*by, "__bucket"]):
            cond = cond & F.col(c).eqNullSafe(F.col(f"__h{i}"))
        run = [*by, "__bucket", "__ts"]
        along = Window.partitionBy(*by, "__bucket").orderBy(*position)
        d = d.withColumn("__next", F.lead(F.struct(F.col("__k").isNull().alias("free"), F.col("__ts").alias("ts"))).over(along))
        d = d.join(heads, cond).drop(*(f"__h{i}" for i in range(len(by) + 1)))
        ends = F.when(F.col("__next").isNull(), F.col("__after")).otherwise(F.col("__next.free") & ~F.col("__next.ts").eqNullSafe(F.col("__ts")))
        same = Window.partitionBy(*run).orderBy(*position).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # as below: one sort for both
        d = d.withColumns({"__next_free": F.max(ends).over(same), "order_run": F.min(where).over(same)})
    else:
        d = _scanned(d, position, by)
        run = [*by, "order_run"]
        d = d.withColumn("__next_free", F.max("__ends").over(Window.partitionBy(*run)))
    # two windows: the place in the run, which gives segments by arithmetic, and what a segment holds up to a row and in all
    inside = Window.partitionBy(*run).orderBy(*position)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"__nth": F.row_number().over(inside) - 1, "__run_size": F.count("*").over(whole)})
    d = d.withColumns({"order_segment": F.floor(F.col("__nth") / max_group), "__last_seg": F.floor((F.col("__run_size") - 1) / max_group)})
    d = d.withColumn("__size", F.least(F.lit(max_group).cast("long"), F.col("__run_size") - F.col("order_segment") * max_group))
    seg = Window.partitionBy(*run, "order_segment").orderBy(*position)
    so_far, in_all = seg.rowsBetween(Window.unboundedPreceding, 0), seg.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({
        "__chunk": F.sum(F.col("__k").isNotNull().cast("long")).over(so_far), "__anchor": F.last("__k", ignorenulls=True).over(so_far),
        "__most": F.max("__k").over(in_all), "__last_key": F.last("__k", ignorenulls=True).over(in_all),
    })
    moved = F.coalesce(F.col("__most"), F.lit(-1)) != F.coalesce(F.col("__last_key"), F.lit(-1))
    arrival = (F.col("__size") == max_group) | (F.col("__next_free") & (F.col("order_segment") == F.col("__last_seg")) & moved)
    d = d.withColumn("order_key", F.when(~arrival, F.col("__anchor"))).withColumn("order_chunk", F.when(arrival, F.lit(0).cast("long")).otherwise(F.col("__chunk")))
    return d.drop(*(c for c in d.columns if c.startswith("__")))


def _scanned(d: DataFrame, position: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """d with order_run, counted over all rows, and __ends: whether a row ends a run before a row without a key at another time.

    Ranges of rows are written once, so that all passes see the same ones. Each tells its first and last time, how its first row is
    and how many runs it opens; from these rows the driver gives each range the number of runs before it, less one where its
    first run is the one that was open, and how the row behind it is.
    """
    spark = d.sparkSession
    where = [*by, *position]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("__at", F.struct(*(F.col(c) for c in by), F.col("__ts"))).withColumn("__free", F.col("__k").isNull())
    d = fixed(ranged(d, parts, *where).withColumn("__range", F.spark_partition_id()))
    along = Window.partitionBy("__range").orderBy(*where)
    before = F.lag("__at").over(along)
    d = d.withColumn("__new", (before.isNotNull() & ~F.col("__at").eqNullSafe(before)).cast("long"))
    d = d.withColumns({"__opened": F.sum("__new").over(along), "__behind": F.lead(F.struct("__at", "__free")).over(along)})
    place = F.struct(*where)
    told = d.groupBy("__range").agg(F.min_by("__at", place).alias("first"), F.min_by("__free", place).alias("free"), F.max_by("__at", place).alias("last"), F.max("__opened").alias("opened"))
    ranges = sorted(told.collect(), key=lambda r: r["__range"])  # a row for each partition
    carried, number = [], 0
    for i, r in enumerate(ranges):
        number += not (i and ranges[i - 1].last == r.first)
        after = ranges[i + 1] if i + 1 < len(ranges) else None
        free = after is not None and after.free and after.first != r.last and all(after.first[c] == r.last[c] for c in by)
        carried.append((r["__range"], number, bool(free)))
        number += r.opened
    if not carried:
        return d.withColumns({"order_run": F.lit(0).cast("long"), "__ends": F.lit(False)})
    scan = F.broadcast(spark.createDataFrame(carried, "__r int, __runs long, __after boolean"))
    d = d.join(scan, F.col("__range") == F.col("__r"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"__behind.__at.{c}").eqNullSafe(F.col(c))
    inside = F.col("__behind.__free") & ~F.col("__behind.__at").eqNullSafe(F.col("__at")) & same
    return d.withColumns({"order_run": F.col("__runs") + F.col("__opened"), "__ends": F.when(F.col("__behind").isNull(), F.col("__after")).otherwise(inside)})


def sort_columns(position: tuple[str, ...] = ("seq",)) -> list:
    return [F.col("order_run"), F.col("order_segment"), F.col("order_key").asc_nulls_first(), F.col("order_chunk"), *(F.col(p) for p in position)]


def run_order(keys: list[int | None], opens_next_free: bool | None, max_group: int = MAX_GROUP) -> list[int]:
    """The canonical order of one run of equal times; the same rule as order_rows, for rows that are at hand.

    opens_next_free: whether what opens the next run has no key.
    """
    out: list[int] = []
    for lo in range(0, len(keys), max_group):
        own = range(lo, min(lo + max_group, len(keys)))
        anchors, anchor = [], None
        for i in own:
            anchor = keys[i] if keys[i] is not None else anchor
            anchors.append(anchor)
        full = len(own) == max_group
        moved = anchor is not None and max(a for a in anchors if a is not None) != anchor
        if full or moved and opens_next_free and own[-1] == len(keys) - 1:
            out += own
            continue
        chunk = np.cumsum([keys[i] is not None for i in own])
        out += [own[j] for j in sorted(range(len(own)), key=lambda j: (-1 if anchors[j] is None else anchors[j], chunk[j]))]
    return out


class Runs:
    """Puts a stream of rows, which come in order of arrival, into canonical order. The last run is held until it is known to be whole."""

    def __init__(self, max_group: int = MAX_GROUP) -> None:
        self.max_group = max_group
        self.opens_free: bool | None = None  # whether the first row of all has no key
        self.capped = 0

    def places(self, stamps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, int]:
        """The canonical order of the whole runs among some rows, and where the last run starts, which stays open. Keys are -1 where there are none."""
        if self.opens_free is None and len(keys):
            self.opens_free = bool(keys[0] < 0)
        first = np.flatnonzero(np.concatenate([[True], stamps[1:] != stamps[:-1]])) if len(stamps) else np.zeros(0, np.int64)
        last = int(first[-1]) if len(first) else 0
        order = np.arange(last)
        sizes = np.diff(first)
        for i in np.flatnonzero(sizes > 1).tolist():
            lo, n = int(first[i]), int(sizes[i])
            order[lo : lo + n] = lo + np.array(self.run(keys[lo : lo + n], bool(keys[lo + n] < 0)))
        return order, last

    def run(self, keys: np.ndarray, opens_next_free: bool, again: bool = False) -> list[int]:
        if len(keys) >= self.max_group > 1 and not again:
            self.capped += 1
        return run_order([None if k < 0 else k for k in keys.tolist()], opens_next_free, self.max_group)
