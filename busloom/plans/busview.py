"""A recording made of the events table, so that every stage can be compared with plain SQL.

Each event becomes one raw record, packed into words as a recording has them; the stages then start from those words. Times
are cut to ten minutes, which makes ties. SQL builds the same records as plain columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode as decoding
from ..operators import delta, pairing
from ..schema import MICROS_PER_DAY

TICK_US = 600_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as columns of integers."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    day, tod = F.dayofyear("ts").cast("int"), F.pmod(us, F.lit(MICROS_PER_DAY))
    kind = F.when(F.col("event_type") == "error", "err").when(F.col("event_type") == "view", "spur").otherwise("clean")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 3).cast("int").alias("file_index"), kind.alias("k"), day.alias("day"), tod.alias("tod"),
        (F.col("user_id") % 32).cast("int").alias("rt0"), (F.expr("event_id div 7") % 32).cast("int").alias("sa0"), (F.col("event_type") == "purchase").cast("int").alias("dir0"),
        (F.col("event_id") % 2).cast("int").alias("bus0"), (F.col("event_id") % 32).cast("int").alias("n0"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of the view."""
    p = plain(spark, sf_dir).withColumn("n", F.when(F.col("n0") == 0, 32).otherwise(F.col("n0"))).withColumn("cut", F.col("tod") - F.col("tod") % TICK_US)
    spur, err = F.col("k") == "spur", F.col("k") == "err"
    code = F.when(spur, 0x20).when(F.col("dir0") == 1, 0x04).otherwise(0x02)
    count = F.when(spur, F.col("n") + 4).otherwise(F.col("n") + 6)
    s = F.floor(F.col("cut") / 1_000_000).cast("int")
    up = F.shiftleft(F.col("day"), 5).bitwiseOR(F.floor(s / 3600).cast("int"))
    mid = F.shiftleft(F.floor(s / 60).cast("int") % 60, 10).bitwiseOR(F.shiftleft(s % 60, 4))
    cmd = F.shiftleft("rt0", 11).bitwiseOR(F.shiftleft("dir0", 10)).bitwiseOR(F.shiftleft("sa0", 5)).bitwiseOR(F.col("n0"))
    data = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: ((F.col("seq") * 31 + j * 17) % 65536).cast("int"))
    status = F.shiftleft((F.col("rt0") + (F.col("seq") % 10 == 0).cast("int")) % 32, 11)
    one = lambda c: F.array(c.cast("int"))
    body = F.when(spur, data).when(err, F.concat(one(cmd), data, one(F.lit(0x0120)))).when(F.col("dir0") == 1, F.concat(one(cmd), one(status), data)).otherwise(F.concat(one(cmd), data, one(status)))
    tw = code.bitwiseOR(F.shiftleft("bus0", 7)).bitwiseOR(F.shiftleft(count, 8)).bitwiseOR(F.shiftleft(err.cast("int"), 14))
    null = F.lit(None).cast("string")
    return p.select("file_index", F.lit("events").alias("source_path"), "seq", (F.col("seq") * 128).alias("file_offset"), F.lit("rec").alias("kind"), F.lit("irig").alias("ts_format"), tw.cast("int").alias("type_word"), up.cast("int").alias("t0"), mid.cast("int").alias("t1"), F.lit(0).alias("t2"), body.alias("body"), F.lit("BUS").alias("mux"), null.alias("detail"))


def records(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Decoded and paired records of the view, with their per-file DELTA."""
    return decoding.with_times(delta.with_delta(pairing.pair(decoding.decode(raw(spark, sf_dir)))), **options)


#: The same in DuckDB's SQL: p has plain columns, b the records before pairing, r those after it, d those with DELTA.
SQL_P = """p as (select event_id seq, cast(user_id % 3 as integer) file_index,
  case event_type when 'error' then 'err' when 'view' then 'spur' else 'clean' end k, cast(dayofyear(ts) as integer) "day",
  epoch_us(ts) % 86400000000 tod, cast(user_id % 32 as integer) rt0, cast((event_id // 7) % 32 as integer) sa0,
  cast(case when event_type = 'purchase' then 1 else 0 end as integer) dir0, cast(event_id % 2 as integer) bus0, cast(event_id % 32 as integer) n0 from events)"""
SQL_B = SQL_P + """, q as (select *, case when n0 = 0 then 32 else n0 end n, tod - tod % 600000000 cut from p),
b as (select seq, file_index, k, "day", cut, bus0 as bus, n,
  cast("day" as bigint) * 86400000000 + cut time_us, k = 'err' error, k = 'spur' spurious,
  case when k <> 'spur' then rt0 end rt, case when k <> 'spur' then sa0 end subaddress, case when k <> 'spur' then dir0 end direction,
  cast(case when k = 'spur' then 32 when dir0 = 1 then 4 else 2 end as integer) message_type,
  cast(case when k <> 'spur' then rt0 * 2048 + dir0 * 1024 + sa0 * 32 + n0 end as integer) command_word,
  cast(case when k = 'clean' then ((rt0 + case when seq % 10 = 0 then 1 else 0 end) % 32) * 2048 end as integer) status_word,
  cast(case when k = 'spur' then 32 when dir0 = 1 then 4 else 2 end + bus0 * 128 + (n + case when k = 'spur' then 4 else 6 end) * 256 + case when k = 'err' then 16384 else 0 end as integer) type_word
  from q)"""
SQL_R = SQL_B + """, l as (select *, lag(k = 'err') over w opens, lag(time_us) over w parent_us from b window w as (partition by file_index order by seq)),
r as (select * exclude (time_us, opens, parent_us), case when spurious and coalesce(opens, false) then parent_us else time_us end time_us,
  cast(case when spurious then case when coalesce(opens, false) then 8192 else 8193 end when k = 'err' then 288 end as integer) error_word,
  spurious and coalesce(opens, false) follows from l)"""
SQL_D = SQL_R + """, e as (select *, last_value(case when rt is not null then time_us end ignore nulls) over (partition by file_index, rt, subaddress, direction order by seq rows between unbounded preceding and 1 preceding) prev from r),
d as (select * exclude (prev), case when rt is null then null when prev is null then 0 when time_us >= prev then time_us - prev end delta_us from e)"""
