"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Sources, by code point (null last), get the weights 5, 2, 1 in turn. Targets share the words of all documents by weight; none
exceeds REPEATS times its source's words, and what is cut off is shared again by weight among the others.

Each source has a schedule: its rate at training time u in [0, 1] is target * (1 + slope * (2u - 1)), whose integral
target * (u + slope * (u^2 - u)) is the words asked of it up to u. Documents of a source stand in a hashed order; a pass over
the source takes each of them once. The words before a document, in a pass, are the demand at which it is due: inverting the
integral gives its time, and the sum of all integrals at that time is its training position. Documents are range-sorted by
position. The last document taken of a source is taken in part, so that every source's words equal its target, rounded.

A table of whole documents can't hold a part of one: apply() writes a document that is taken in part if that is at least half, and
the first of a source always, so no source that has words and a target is left out.

A null or empty text has size 0 and is taken 0 words; a null source is a source of its own. Repeated rows are documents of
their own; between equal rows any order holds. Without words all targets are 0. Columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, numbered

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Slopes of the schedules, in turn: a source comes rather late, evenly or rather early.
SLOPES = (0.5, 0.0, -0.5)
ROWS_PER_BUCKET = 2_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target, slope and the sums over all sources, for each source; sizes has source and source_size, one row per source.

    A target is min(repeats * size, level * weight); sources are ordered by the level at which they reach their cap, and the
    level follows from running sums. One row per source, whatever the number of documents.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn % len(weights) + 1).cast("int"))
    slope = F.element_at(F.array(*(F.lit(x) for x in SLOPES)), (turn % len(SLOPES) + 1).cast("int"))
    named = sizes.withColumn("w", w).withColumn("slope", slope).withColumn("cap", F.col("source_size") * float(repeats)).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # the first source, in this order, that the level of those from it on does not cap sets the level for all
    found = named.withColumn("own", level).withColumn("level", F.max(F.when(F.col("own") <= F.col("cap") / F.col("w"), F.col("own"))).over(everything))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap"))
    sums = [F.sum("target").over(everything).alias("all_targets"), F.sum(F.col("target") * F.col("slope")).over(everything).alias("all_slopes")]
    return found.select("source", "source_size", target.alias("target"), "slope").select("*", *sums)


def _demand(u: Column, target: Column, slope: Column) -> Column:
    return target * (u + slope * (u * u - u))


def _due(demand: Column, target: Column, slope: Column) -> Column:
    """The time at which a source is asked for so many words."""
    y = F.least(F.coalesce(demand / F.nullif(target, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    root = (slope - 1 + F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * y, F.lit(0.0)))) / (2 * F.nullif(slope, F.lit(0.0)))
    return F.coalesce(root, y)


def _position(due: Column) -> Column:
    """The number of words that all sources have been asked for at a time."""
    return F.col("all_targets") * due + F.col("all_slopes") * (due * due - due)


#: Sources whose targets are broadcast, a row each.
MAX_BROADCAST_SOURCES = 10_000


def _hash(key: str, text: str, seed: int) -> Column:
    """60 even bits that order the documents of a source."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string"))), 1, 15), 16, 10).cast("long")


def _planned(rows: DataFrame, narrow: DataFrame, order: list[str]) -> DataFrame:
    """rows (source, size, hash and more) with source_size, target, slope, sums, start (words of the source before it) and quota.

    narrow has the source, size and hash of the same rows; what is summed over all rows is read from it.
    """
    sizes = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    ordered = numbered(rows.withColumn("__named", named), ["__named"], [F.col(c) for c in order], F.col("hash"), ROWS_PER_BUCKET, F.col("size"), nullable=False, width=60, totals=narrow.withColumn("__named", named))
    own = checkpointed(sizes.withColumn("__own", named).drop("source"))
    own = F.broadcast(own) if own.count() <= MAX_BROADCAST_SOURCES else own
    return ordered.join(own, F.col("__named") == F.col("__own")).drop("__named", "__own").withColumn("quota", F.round("target").cast("long"))


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 8) -> DataFrame:
    """key, source, size, source_size, target, slope, sums, start (words of the source before it), quota and taken, for each row."""
    rows = documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{source}`").cast("string").alias("source"), words(text).alias("size"), _hash(key, text, seed).alias("hash"))
    rows = checkpointed(rows)  # a narrow table, read several times; the texts are read once
    planned = _planned(rows, rows, ["__key", "size"]).drop("hash")
    taken = sum((F.least(F.greatest(F.col("quota") - F.col("start") - F.col("source_size") * p, F.lit(0)), F.col("size")) for p in range(REPEATS)), F.lit(0).cast("long"))
    return planned.withColumn("taken", taken.cast("long")).withColumnRenamed("__key", key)


def schedule(mixed: DataFrame, share: float = 0.0) -> DataFrame:
    """One row for each time that at least a share of a document is taken (of a source's first document: any), with pass, words, due and position, range-sorted by position.

    position is the number of words that all sources have been asked for when the document is due.
    """
    passes = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    passes = passes.withColumn("before", F.col("start") + F.col("source_size") * F.col("pass")).withColumn("words", F.least(F.col("quota") - F.col("before"), F.col("size"))).filter((F.col("words") > 0) & ((F.col("words") >= F.col("size") * share) | (F.col("before") == 0)))
    due = passes.withColumn("due", _due(F.col("before").cast("double"), F.col("target"), F.col("slope")))
    placed = due.withColumn("position", _position(F.col("due")))
    return placed.drop("before", "all_targets", "all_slopes").orderBy("position", "source", "start", "pass")


def first_positions(mixed: DataFrame) -> DataFrame:
    """mixed with first_due and first_position: the time and the training position (in whole words) at which a document is first due,
    null if it never is; and n_passes, how often it is due. Range-sorted by the position."""
    due = F.when(F.col("taken") > 0, _due(F.col("start").cast("double"), F.col("target"), F.col("slope")))
    passes = sum((F.when((F.col("size") > 0) & (F.col("quota") > F.col("start") + F.col("source_size") * p), 1).otherwise(0) for p in range(REPEATS)), F.lit(0))
    placed = mixed.withColumn("first_due", due).withColumn("first_position", F.round(_position(F.col("first_due"))).cast("long")).withColumn("n_passes", passes)
    return placed.orderBy(F.col("first_due").asc_nulls_last(), "source", "start")


def apply(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 8) -> DataFrame:
    """documents, each row as often as the mix takes it, range-sorted by training position; all columns stay.

    A last pass that takes less than half of a document is left out, but for the first document of a source; one of size 0 is never taken.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("__row")
    rows = documents.select(whole, F.col(f"`{key}`").alias("__key"), F.col(f"`{source}`").cast("string").alias("source"), words(text).alias("size"), _hash(key, text, seed).alias("hash"))
    narrow = checkpointed(rows.select("source", "size", "hash"))
    return schedule(_planned(rows, narrow, ["__key", "size"]).drop("hash"), 0.5).select("__row.*")
