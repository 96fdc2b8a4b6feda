"""Error and continuation: a spurious record right behind an errored one belongs to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words
from ..schema import CONTINUATION, SPURIOUS_TYPE, STANDALONE

#: Fields that a continuation takes over from its parent; its texts of time are made of these afterwards.
TIMES = ("time_us", "ticks", "freerun", "day_of_year", "time_of_day_us")
#: Records of a file that one group of a window holds, by number.
SPAN = 1 << 16


def pair(decoded: DataFrame) -> DataFrame:
    """Records with the error word of spurious ones, and a continuation's time taken from its parent.

    Skipped records and resyncs stand between records here and break pairs; they leave afterwards. If the source tells the
    words of a continuation's parent this is a projection; else files are cut by SPAN numbers: a window inside each span, and what stands before
    its first record comes from one row for each span.
    """
    spurious = F.col("message_type") == SPURIOUS_TYPE
    if "parent" in decoded.columns:
        df = decoded.filter("kind = 'rec'")
        follows = F.col("parent").isNotNull()
        took = _times_of_parent(F.col("ticks_began") if "ticks_began" in decoded.columns else None) | {"time_us": F.col("stamp_us")}
    else:
        opens = (F.col("kind") == "rec") & F.col("error") & ~spurious
        own = F.struct(opens.alias("opens"), *TIMES)
        df = decoded.withColumn("__span", F.floor(F.col("seq") / SPAN))
        spans = df.groupBy("file_index", "__span").agg(F.max_by(own, "seq").alias("__last"))
        spans = spans.withColumn("__last", F.lag("__last").over(Window.partitionBy("file_index").orderBy("__span")))  # a row for each span
        spans = spans.select(F.col("file_index").alias("__f"), F.col("__span").alias("__s"), "__last")
        inside = F.lag(own).over(Window.partitionBy("file_index", "__span").orderBy("seq"))
        df = df.withColumn("__before", inside).join(spans, F.col("file_index").eqNullSafe(F.col("__f")) & F.col("__span").eqNullSafe(F.col("__s")))
        df = df.withColumn("__before", F.coalesce("__before", "__last"))
        df = df.withColumn("__follows", spurious & F.coalesce(F.col("__before.opens"), F.lit(False))).filter("kind = 'rec'")
        follows = F.col("__follows")
        took = {c: F.col(f"__before.{c}") for c in TIMES}
    times = {c: F.when(follows, took[c]).otherwise(F.col(c)) for c in TIMES if c in df.columns}
    code = F.when(spurious, F.when(follows, CONTINUATION).otherwise(STANDALONE)).otherwise(F.col("error_word"))
    return df.withColumns(times | {"error_word": code}).drop("__before", "__follows", "__span", "__f", "__s", "__last", "stamp_us", "ticks_began")


def _times_of_parent(began: Column | None) -> dict:
    """The fields of time in the words of a parent: type word, two or three words of time, and the rest."""
    irig = F.col("ts_format") == "irig"
    up, mid, low = (F.get("parent", F.lit(i)) for i in (1, 2, 3))
    of_day = words.time_of_day_us(words.irig_hour(up), words.irig_minute(mid), words.irig_second(mid), words.irig_micros(mid, low))
    return {"ticks": F.when(~irig, words.led_on(words.standard_ticks(up, mid), began)), "freerun": F.when(irig, words.irig_freerun(up)), "day_of_year": F.when(irig, words.irig_day(up)).cast("smallint"), "time_of_day_us": F.when(irig, of_day)}


def parent_fields() -> dict:
    """The type, bus, terminal and subaddress of a parent, from its words."""
    command = F.get("parent", F.when(F.col("ts_format") == "irig", 4).otherwise(3))
    first = F.get("parent", F.lit(0))
    return {"message_type": words.type_code(first), "bus": words.type_bus(first), "rt": words.command_rt(command), "subaddress": words.command_subaddress(command)}


def is_continuation():
    return F.coalesce((F.col("message_type") == SPURIOUS_TYPE) & (F.col("error_word") == CONTINUATION), F.lit(False))
