"""Duplicates of one transaction in several recordings.

Files in order of time need no state but by words. Where a cap can bind, or a file steps back in time, any record may drive any kept one
out, and the verdict on a record hangs on all before it. Such a merge is cut into blocks, and blocks run at once: each
from an empty set of survivors at first, and its last set is kept. Then a block is run again from the set that the block before ended with, side
by side with the run before, only until both hold the same survivors: from there on nothing differs. A block in which they never meet ends with another set, and the next
one is looked at again. Old survivors leave by window or cap, so sets meet soon, and two rounds mostly do. A last run gives the verdicts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_DATA_WORDS
from ..shared import fixed, ranged
from .pairing import is_continuation

#: What makes two records the same transaction: words, and neither time nor place.
IDENTITY = ("type_word", "command_word", "command_word_2", "status_word", "status_word_2", "error_word", "data_words")
DEFAULT_CAP = 4096
#: Bytes of the survivors of all blocks together, at most, and of one of them: what the driver holds and tasks get.
STATE_BYTES, ENTRY_BYTES = 64 << 20, 40


def identity(of: dict[str, Column] | None = None) -> list[Column]:
    """Two hashes of the words of a record (128 bits, so equal hashes are equal words); of gives other columns for them."""
    parts = [(of or {}).get(c, F.col(c)) for c in IDENTITY]
    told = F.struct(*(F.coalesce(x.cast("array<int>") if c == "data_words" else F.array(x.cast("int")), F.array().cast("array<int>")).alias(c) for c, x in zip(IDENTITY, parts, strict=True)))
    return [F.xxhash64(F.lit(1), told).alias("__d1"), F.xxhash64(told, F.lit(2)).alias("__d2")]


def _of_parent() -> dict[str, Column]:
    """The fields of identity of an errored record, from its words."""
    first = F.when(F.col("ts_format") == "irig", 4).otherwise(3)
    none = F.lit(None).cast("int")
    data = F.slice("parent", first + 2, F.least(F.greatest(F.size("parent") - first - 2, F.lit(0)), F.lit(MAX_DATA_WORDS)))
    return {"type_word": F.get("parent", F.lit(0)), "command_word": F.get("parent", first), "command_word_2": none, "status_word": none, "status_word_2": none, "error_word": F.element_at("parent", -1), "data_words": data}


class Survivors:
    """The sequential rule: a record is a duplicate if a kept one of another file has its words, within the window.

    Kept records leave once any record is farther than the window from them, or when there are more than cap. Two heaps give
    those that are too early or too late, and a table by words those that may match, so a record costs a logarithm.
    """

    def __init__(self, window_us: int, cap: int | None = None) -> None:
        self.window, self.cap = window_us, cap
        self.early: list[tuple[int, int]] = []
        self.late: list[tuple[int, int]] = []
        self.alive: dict[int, tuple] = {}  # by number, in the order of arrival: file, words, time, place
        self.by_words: dict[object, dict[int, int]] = {}
        self.number = self.dropped_early = 0
        self.told = 0  # tells sets of survivors apart

    def _forget(self, n: int) -> None:
        file, digest, _, place = self.alive.pop(n)
        self.told ^= hash((file, place))
        same = self.by_words[digest]
        del same[n]
        if not same:
            del self.by_words[digest]

    def keep(self, us: int, file: int, digest: object, place: int = 0) -> None:
        n = self.number
        self.number += 1
        self.alive[n] = (file, digest, us, place)
        self.told ^= hash((file, place))
        self.by_words.setdefault(digest, {})[n] = file
        heapq.heappush(self.early, (us, n))
        heapq.heappush(self.late, (-us, n))

    def state(self) -> bytes:
        """The survivors in the order of arrival; they arrive again by enter()."""
        return np.array([(us, file, place, *digest) for file, digest, us, place in self.alive.values()], np.int64).tobytes()

    def enter(self, state: bytes) -> Survivors:
        for us, file, place, d1, d2 in np.frombuffer(state, np.int64).reshape(-1, 5).tolist():
            self.keep(us, file, (d1, d2), place)
        return self

    def duplicate(self, us: int, file: int, digest: object, place: int = 0) -> bool:
        for heap, least in ((self.early, us - self.window), (self.late, -us - self.window)):
            while heap and heap[0][0] < least:
                n = heapq.heappop(heap)[1]
                if n in self.alive:
                    self._forget(n)
        if any(f != file for f in self.by_words.get(digest, {}).values()):
            return True
        self.keep(us, file, digest, place)
        if self.cap is not None and len(self.alive) > self.cap:
            self._forget(next(iter(self.alive)))
            self.dropped_early += 1
        return False


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)


def _fold(window_us: int):
    """Runs the rule over sorted rows; a new group starts fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rule = None, None
        for b in batches:
            out = []
            for g, us, file, d1, d2, _ in _rows(b):
                if rule is None or g != group:
                    group, rule = g, Survivors(window_us)
                out.append(us is not None and rule.duplicate(us, file, (d1, d2)))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(5), pa.array(out, pa.bool_()), pa.array([False] * len(out), pa.bool_())], ["f", "s", "duplicate", "early"])

    return run


def _block(window_us: int, cap: int | None, entering: dict[int, bytes]):
    """Verdicts on the rows of a block, from its survivors on entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = None
        for b in batches:
            out, early = [], []
            for block, us, file, d1, d2, place in _rows(b):
                rule = rule or Survivors(window_us, cap).enter(entering.get(block, b""))
                before = rule.dropped_early
                out.append(us is not None and rule.duplicate(us, file, (d1, d2), place))
                early.append(rule.dropped_early > before)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(5), pa.array(out, pa.bool_()), pa.array(early, pa.bool_())], ["f", "s", "duplicate", "early"])

    return run


def _ends(window_us: int, cap: int | None, before: dict[int, bytes] | None, entering: dict[int, bytes]):
    """The survivors at the end of each block that is to run, unless they come to be those of the run before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = other = block = None
        for b in batches:
            for block, us, file, d1, d2, place in _rows(b):
                if rule is None:
                    if before is not None and block not in entering:
                        return  # as it was
                    rule = Survivors(window_us, cap).enter(entering.get(block, b""))
                    other = Survivors(window_us, cap).enter(before[block]) if before is not None else None
                if us is None:
                    continue
                rule.duplicate(us, file, (d1, d2), place)
                if other is not None:
                    other.duplicate(us, file, (d1, d2), place)
                    if rule.told == other.told and len(rule.alive) == len(other.alive) and rule.state() == other.state():
                        return  # the same from here on
        if rule is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([rule.state()], pa.binary())], ["block", "state"])

    return run


def in_blocks(rows: DataFrame, window_us: int, cap: int | None, blocks: int) -> tuple[DataFrame, int]:
    """The sequential rule over rows (time_us, file_index, __d1, __d2, seq, merge_us): f, s, duplicate, early, and how many rounds it took."""
    order = ("merge_us", "file_index", "seq")
    dealt = ranged(rows, blocks, *order)
    dealt = fixed(dealt.select(F.spark_partition_id().cast("long").alias("block"), "time_us", "file_index", "__d1", "__d2", "seq", "__dealt"))
    ended: dict[int, bytes] = {}
    used: dict[int, bytes] | None = None
    entering: dict[int, bytes] = {}
    rounds = 0
    while used is None or entering:
        for r in dealt.mapInArrow(_ends(window_us, cap, used, entering), "block bigint, state binary").collect():  # STATE_BYTES in all
            ended[r.block] = bytes(r.state)
        rounds += 1
        there = sorted(ended)
        used = {**dict.fromkeys(there, b""), **(used or {}), **entering}
        entering = {b: ended[a] for a, b in zip(there, there[1:], strict=False) if used[b] != ended[a]}
    return dealt.mapInArrow(_block(window_us, cap, used), "f int, s bigint, duplicate boolean, early boolean"), rounds


def blocks_for(df: DataFrame, cap: int | None) -> int:
    """As many as there are shuffle partitions, but for what their survivors take. Without a cap survivors are bounded by the window alone."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, STATE_BYTES // (ENTRY_BYTES * (cap or DEFAULT_CAP))))


def cap_binds(df: DataFrame, window_us: int, cap: int) -> bool:
    """Whether more than cap records may be within the window of one: no, if no two neighbouring spans of its length hold as many."""
    span = F.floor(F.col("time_us") / (window_us + 1))
    counts = df.filter(~is_continuation()).groupBy(span.alias("span")).agg(F.count("*").alias("n"))
    spans = counts.select("span", "n").unionByName(counts.select((F.col("span") + 1).alias("span"), "n"))
    return spans.groupBy("span").agg(F.sum("n").alias("n")).filter(F.col("n") > cap).limit(1).count() > 0


def marked(df: DataFrame, window_us: int = 0, cap: int | None = None, monotone: bool = True) -> DataFrame:
    """df (merged) with collapsed. Three plans, equal where more than one holds:

    a window by time and words, if the window is 0 and files are in order of time; a fold by words, if they are in order and
    the window is larger; and else, or if more records may be within the window than cap allows, the rule over all rows in the
    order of the merge, in blocks, since then any record can drop any kept one. Such a result has capped too: whether the cap
    dropped a record there.
    """
    follows = is_continuation()
    told = "parent" in df.columns
    digest = identity()
    if told:  # a continuation goes with its parent
        digest = [F.when(F.col("parent").isNotNull(), x).otherwise(own).alias(f"__d{i + 1}") for i, (own, x) in enumerate(zip(digest, identity(_of_parent()), strict=True))]
    own = df.select("*", *digest)
    whole = not monotone or cap is not None and cap_binds(df, window_us, cap)
    if not whole and window_us == 0:
        w = Window.partitionBy("time_us", "__d1", "__d2", *([] if told else [follows]))
        least = F.min(F.when(~follows, F.col("file_index"))).over(w)
        verdict = own.withColumn("__dup", F.coalesce(F.col("time_us").isNotNull() & (F.col("file_index") > least), F.lit(False)))
    else:
        rows = own.filter(~follows).select("time_us", "file_index", "__d1", "__d2", "seq", "merge_us")
        if whole:
            found, _ = in_blocks(rows, window_us, cap, blocks_for(df, cap))
        else:
            parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            dealt = rows.select(F.col("__d1").alias("__g"), "time_us", "file_index", "__d1", "__d2", "seq", "merge_us").repartition(parts, "__g")
            found = dealt.sortWithinPartitions("__g", "merge_us", "file_index", "seq").mapInArrow(_fold(window_us), "f int, s bigint, duplicate boolean, early boolean")
        dups = found.filter("duplicate or early").select(F.col("f").alias("__f"), F.col("s").alias("__s"), F.col("duplicate").alias("__d"), F.col("early").alias("__e"))
        at = F.when(F.col("parent").isNotNull(), F.col("seq") - 1).otherwise(F.col("seq")) if told else F.col("seq")  # a parent stands right before
        verdict = own.join(dups, (F.col("file_index") == F.col("__f")) & (at == F.col("__s")), "left").withColumn("__dup", F.coalesce("__d", F.lit(False)))
        if whole:
            verdict = verdict.withColumn("capped", F.coalesce("__e", F.lit(False)) & ~follows)
        verdict = verdict.drop("__f", "__s", "__d", "__e")
    if told:
        return verdict.withColumnRenamed("__dup", "collapsed").drop("__d1", "__d2")
    before = F.lag("__dup").over(Window.partitionBy("file_index").orderBy("seq"))
    verdict = verdict.withColumn("__before", F.coalesce(before, F.lit(False)))
    return verdict.withColumn("collapsed", F.when(follows, F.col("__before")).otherwise(F.col("__dup"))).drop("__d1", "__d2", "__dup", "__before")


def collapse(df: DataFrame, window_us: int = 0, cap: int | None = None, monotone: bool = True) -> DataFrame:
    return marked(df, window_us, cap, monotone).filter(~F.col("collapsed")).drop("collapsed", "capped")
