"""Recordings in bytes made of the events table, so that framing can be compared with plain SQL.

Forty events make a file, one record each. Words are chosen so that no word inside a record could pass for a record's first
(data end on 7 set bits, subaddresses on 2, seconds are multiples of 8), so plain sums of lengths tell where a reader must find
each record, whatever is put between them. Built-in expressions pack the words into little-endian bytes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_path
from .busview import events

EVENTS_OF_FILE = 40
JUNK = 0xFFFF


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the plain fields of records: file, place, data words n, terminal, subaddress, direction and words of time."""
    e = events(spark, sf_dir).select(F.col("event_id").alias("e"), F.col("user_id").alias("u"))
    at = F.col("e")
    return e.select(
        "e", F.expr(f"cast(e div {EVENTS_OF_FILE} as int)").alias("f"), (at % EVENTS_OF_FILE).cast("int").alias("p"), (2 + at % 7).cast("int").alias("n"), (F.col("u") % 31).cast("int").alias("rt"),
        ((at % 7) * 4 + 3).cast("int").alias("sa"), (at % 2).cast("int").alias("dir"), F.lit(10).alias("day"), F.lit(3).alias("hour"), (at % EVENTS_OF_FILE).cast("int").alias("minute"),
        ((at % 7) * 8).cast("int").alias("second"), ((at % 500) * 128 + 127).cast("int").alias("micro"),
    )


def word(x) -> Column:
    return F.array((x if isinstance(x, Column) else F.lit(x)).cast("int"))


def data(n: str = "n") -> Column:
    return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda j: ((F.col("e") * 31 + j * 17) % 512 * 128 + 127).cast("int"))


def command() -> Column:
    return F.col("rt") * 2048 + F.col("dir") * 1024 + F.col("sa") * 32 + F.col("n")


def stamp(free: Column | bool = False) -> Column:
    up = F.col("day") * 32 + F.col("hour") + (F.lit(free) if isinstance(free, bool) else free).cast("int") * 32768
    return F.concat(word(up), word(F.col("minute") * 1024 + F.col("second") * 16 + F.floor(F.col("micro") / 65536)), word(F.col("micro") % 65536))


#: Ticks from one event to the next.
TICKS = 1280


def counter() -> Column:
    """The two words of a counter of 32 bits, which wraps."""
    ticks = F.col("e") * TICKS + 127
    return F.concat(word(F.floor(ticks / 65536) % 65536), word(ticks % 65536))


def body() -> Column:
    """Command, data and status words of a plain message in either direction."""
    status = word(F.col("rt") * 2048)
    return F.when(F.col("dir") == 0, F.concat(word(command()), data(), status)).otherwise(F.concat(word(command()), status, data()))


def record(code: Column | None = None, time: Column | None = None, rest: Column | None = None, error: Column | bool = False) -> Column:
    """All words of a record; its length follows from them."""
    code = F.when(F.col("dir") == 0, 2).otherwise(4) if code is None else code
    time, rest = stamp() if time is None else time, body() if rest is None else rest
    count = 1 + F.size(time) + F.size(rest)
    flag = (F.lit(error) if isinstance(error, bool) else error).cast("int")
    return F.concat(word(code + (F.col("e") % 2) * 128 + count * 256 + flag * 16384), time, rest)


def junk(n: Column | int) -> Column:
    return F.array_repeat(F.lit(JUNK), (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def files(rows: DataFrame, words: Column, tail: Column | str = "", name: Column | None = None, cut: Column | None = None, keep: Column | None = None) -> DataFrame:
    """(file_index, name, content): the words of a file's events in order, with a tail, and cut by some bytes at the end."""
    hexed = F.concat_ws("", F.transform(words, lambda w: F.lpad(F.hex(F.shiftleft(w.bitwiseAND(255), 8).bitwiseOR(F.shiftright(w, 8))), 4, "0")))
    one = rows.select("f", F.struct("e", hexed.alias("h")).alias("x")).groupBy("f").agg(F.array_sort(F.collect_list("x")).alias("x"))  # forty to a file
    tail = F.lit(tail) if isinstance(tail, str) else tail
    text = F.expr("left(__t, length(__t) - 2 * __c)")
    made = one.withColumn("__t", F.concat_ws("", F.concat_ws("", F.transform("x", lambda x: x["h"])), tail)).withColumn("__c", (cut if cut is not None else F.lit(0)).cast("int"))
    if keep is not None:
        made = made.filter(keep)
    return made.select(F.col("f").alias("file_index"), (name if name is not None else F.lit("x.rec")).alias("name"), F.unhex(text).alias("content"))


#: Events of a longer recording: a minute apart, in the hours from 0 to 19 of a day.
EVENTS_OF_LONG = 1200


def long_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of recordings that are long enough to be read in pieces."""
    place = F.col("e") % EVENTS_OF_LONG
    return clips(spark, sf_dir).withColumns({"f": F.expr(f"cast(e div {EVENTS_OF_LONG} as int)"), "p": place.cast("int"), "hour": F.floor(place / 60).cast("int"), "minute": (place % 60).cast("int")})


def put(contents: DataFrame) -> list[str]:
    """Recordings of a table (file_index, name, content) as files in the shared folder, written by the tasks that hold them; their paths by file_index.

    A task that runs again writes the same bytes under the same name.
    """
    folder = os.path.join(shared_path(contents.sparkSession), f"recordings-{uuid.uuid4().hex}")

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in found:
            index, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, raw in zip(index, raws, strict=True):
                own = os.path.join(folder, f".{i}.{uuid.uuid4().hex}")
                with open(own, "wb") as f:
                    f.write(raw)
                os.replace(own, os.path.join(folder, f"{i:06d}.rec"))
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32())], ["i"])

    indexes = sorted(r.i for r in contents.select("file_index", "content").mapInArrow(write, "i int").collect())  # a number for each file, as a run has of its inputs
    return [os.path.join(folder, f"{i:06d}.rec") for i in indexes]


#: The same fields in DuckDB's SQL.
SQL_CLIPS = f"""c as (select event_id e, cast(event_id // {EVENTS_OF_FILE} as integer) f, cast(event_id % {EVENTS_OF_FILE} as integer) p, cast(2 + event_id % 7 as integer) n, cast(user_id % 31 as integer) rt,
  cast((event_id % 7) * 4 + 3 as integer) sa, cast(event_id % 2 as integer) dir, cast((event_id % 7) * 8 as integer) "second", cast((event_id % 500) * 128 + 127 as integer) micro from events),
t as (select *, cast(case when dir = 0 then 2 else 4 end + (e % 2) * 128 + (n + 6) * 256 as integer) tw, rt * 2048 + dir * 1024 + sa * 32 + n cmd,
  cast(10 as bigint) * 86400000000 + cast(3 as bigint) * 3600000000 + cast(p as bigint) * 60000000 + "second" * 1000000 + micro us from c)"""
SQL_LONG = f"""{SQL_CLIPS.split(chr(10) + "t as")[0]}
l as (select * exclude (f, p), cast(e // {EVENTS_OF_LONG} as integer) f, cast(e % {EVENTS_OF_LONG} as integer) p, cast(case when dir = 0 then 2 else 4 end as integer) code, rt * 2048 + dir * 1024 + sa * 32 + n cmd,
  cast(10 as bigint) * 86400000000 + (e % {EVENTS_OF_LONG} // 60) * 3600000000 + (e % 60) * 60000000 + "second" * 1000000 + micro us from c)"""
