"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render, words
from ..operators import analytics, collapse, delta, filters, merge, order
from ..operators import columns as cols
from ..operators import decode as decoding
from ..sources import sink
from . import busview as bus
from . import byte_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Words of any value, for functions on single words: w and v spread over 16 bits, and fields that may not fit.
_WORDS = "u as (select event_id, cast((event_id * 40503 + 12345) % 65536 as integer) w, cast((event_id * 30011 + 777) % 65536 as integer) v, cast((event_id * 7919) % 65536 as integer) x from events)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = lambda a, b: ((F.col("event_id") * a + b) % 65536).cast("int")
    return bus.events(spark, sf_dir).select("event_id", spread(40503, 12345).alias("w"), spread(30011, 777).alias("v"), spread(7919, 0).alias("x"))


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _wvx():
    return F.col("w"), F.col("v"), F.col("x")


@query(f"with {_WORDS} select event_id, cast(w & 127 as integer) code, cast((w >> 7) & 1 as integer) bus, cast((w >> 8) & 63 as integer) n_words, ((w >> 14) & 1) = 1 error, ((w >> 15) & 1) = 1 reserved from u")
def type_word_fields(spark, sf_dir):
    w, v, x = _wvx()
    return _words(spark, sf_dir).select("event_id", words.type_code(w).alias("code"), words.type_bus(w).alias("bus"), words.type_word_count(w).alias("n_words"), words.type_error(w).alias("error"), words.type_reserved(w).alias("reserved"))


@query(f"with {_WORDS} select event_id, cast((w >> 11) & 31 as integer) rt, cast((w >> 10) & 1 as integer) direction, cast((w >> 5) & 31 as integer) subaddress, cast(case when w & 31 = 0 then 32 else w & 31 end as integer) n_data, (w >> 11) & 31 = 31 broadcast, ((w >> 5) & 31) in (0, 31) mode_code from u")
def command_word_fields(spark, sf_dir):
    w, v, x = _wvx()
    rt, sa = words.command_rt(w), words.command_subaddress(w)
    return _words(spark, sf_dir).select("event_id", rt.alias("rt"), words.command_direction(w).alias("direction"), sa.alias("subaddress"), words.command_count(w).alias("n_data"), words.is_broadcast(rt).alias("broadcast"), words.is_mode_code(sa).alias("mode_code"))


@query(f"""with {_WORDS} select event_id, cast((w >> 5) & 511 as integer) "day", (w >> 15) & 1 = 1 freerun,
  cast(w & 31 as bigint) * 3600000000 + cast((v >> 10) & 63 as bigint) * 60000000 + cast((v >> 4) & 63 as bigint) * 1000000 + ((v & 15) << 16) + x of_day,
  cast((w >> 5) & 511 as bigint) * 86400000000 + cast(w & 31 as bigint) * 3600000000 + cast((v >> 10) & 63 as bigint) * 60000000 + cast((v >> 4) & 63 as bigint) * 1000000 + ((v & 15) << 16) + x total from u""")
def irig_unpack(spark, sf_dir):
    w, v, x = _wvx()
    tod = words.time_of_day_us(words.irig_hour(w), words.irig_minute(v), words.irig_second(v), words.irig_micros(v, x))
    return _words(spark, sf_dir).select("event_id", words.irig_day(w).alias("day"), words.irig_freerun(w).alias("freerun"), tod.alias("of_day"), words.total_us(words.irig_day(w), tod).alias("total"))


@query(f"with {_WORDS} select event_id, cast(w as bigint) * 65536 + v ticks, printf('0x%08X', cast(w as bigint) * 65536 + v) as rendered from u")
def standard_unpack(spark, sf_dir):
    w, v, x = _wvx()
    t = words.standard_ticks(w, v)
    return _words(spark, sf_dir).select("event_id", t.alias("ticks"), render.counter(t).alias("rendered"))


@query(f"with {_WORDS} select event_id, cast(round((cast(w as double) * 65536 + v) * 1e6 / 1234567.0::double) as bigint) us from u")
def ticks_to_us(spark, sf_dir):
    w, v, x = _wvx()
    return _words(spark, sf_dir).select("event_id", words.ticks_to_us(words.standard_ticks(w, v), 1234567.0).alias("us"))


@query(f"""with {_WORDS}, f as (select event_id, cast(w % 140 as integer) code, cast(v % 2 as integer) bus, cast(x % 70 as integer) n, cast(w % 2 as integer) err from u)
  select event_id, case when code <= 127 and n <= 63 then cast(code + bus * 128 + n * 256 + err * 16384 as integer) end packed from f""")
def pack_roundtrip(spark, sf_dir):
    w, v, x = _wvx()
    return _words(spark, sf_dir).select("event_id", words.pack_type_word(w % 140, v % 2, x % 70, w % 2).alias("packed"))


@query(f"with {_WORDS} select event_id, cast((w >> 11) & 31 as integer) status_rt, ((w >> 11) & 31) <> ((v >> 11) & 31) mismatch from u")
def status_rt_anomaly(spark, sf_dir):
    w, v, x = _wvx()
    return _words(spark, sf_dir).select("event_id", words.status_rt(w).alias("status_rt"), (words.status_rt(w) != words.command_rt(v)).alias("mismatch"))


#: Shapes of any kind: a known type, a command word, a word count and the words of a time.
_SHAPES = _WORDS + """, s as (select event_id, cast([1, 2, 4, 8, 16, 24, 32][cast(event_id % 7 as integer) + 1] as integer) code, w, v, cast(4 + x % 60 as integer) n_words, cast(2 + event_id % 2 as integer) ts_words from u),
  c as (select *, cast((w >> 11) & 31 as integer) rt, cast((w >> 10) & 1 as integer) direction, cast(case when w & 31 = 0 then 32 else w & 31 end as integer) declared, cast((v >> 10) & 1 as integer) direction2, cast(case when event_id % 3 = 0 then case when w & 31 = 0 then 32 else w & 31 end else case when v & 31 = 0 then 32 else v & 31 end end as integer) declared2 from s),
  f as (select *, cast(case code when 1 then case when rt = 31 then case when n_words >= ts_words + 3 then 10 else 9 end when n_words >= ts_words + 4 then case when direction = 1 then 6 else 7 end else 8 end
    when 2 then 1 when 4 then 2 when 8 then 3 when 16 then 4 when 24 then 5 when 32 then 11 end as integer) fmt from c)"""


def _shapes(spark, sf_dir):
    w, v, x = _wvx()
    d = _words(spark, sf_dir)
    code = F.element_at(F.array(*(F.lit(c) for c in (1, 2, 4, 8, 16, 24, 32))), (F.col("event_id") % 7 + 1).cast("int"))
    d = d.select("event_id", code.alias("code"), w, v, (4 + x % 60).alias("n_words"), (2 + F.col("event_id") % 2).cast("int").alias("ts_words"))
    d = d.withColumns({"rt": words.command_rt(w), "direction": words.command_direction(w), "declared": words.command_count(w), "direction2": words.command_direction(v)})
    d = d.withColumn("declared2", F.when(F.col("event_id") % 3 == 0, F.col("declared")).otherwise(words.command_count(v)))
    return d.withColumn("fmt", decoding.message_format(F.col("code"), F.col("rt"), F.col("direction"), F.col("n_words"), F.col("ts_words")))


@query(f"with {_SHAPES} select event_id, fmt from f")
def classify_format(spark, sf_dir):
    return _shapes(spark, sf_dir).select("event_id", "fmt")


@query(f"with {_SHAPES} select fmt, count(*) n from f where code = 1 group by fmt")
def mode_code_shape(spark, sf_dir):
    return _shapes(spark, sf_dir).filter("code = 1").groupBy("fmt").agg(F.count("*").alias("n"))


@query(f"""with {_SHAPES}, g as (select *, case when fmt in (1, 2) then declared + 1 when fmt = 3 then declared + 3 when fmt = 4 then declared when fmt = 5 then declared + 2 when fmt in (6, 7) then 2 when fmt in (8, 10) then 1 else 0 end least from f)
  select event_id, case when code = 2 and direction <> 0 then 'direction-bc-to-rt' when code = 4 and direction <> 1 then 'direction-rt-to-bc' when n_words < ts_words + 2 + least then 'word-count-capacity'
    when fmt in (3, 5) and direction2 <> 0 then 'direction-second-command' when fmt in (3, 5) and declared <> declared2 then 'data-word-count-mismatch' end reason from g""")
def reject_reasons(spark, sf_dir):
    c = F.col
    why = decoding.reject_reason(c("code"), c("direction"), c("n_words"), c("fmt"), c("declared"), c("ts_words"), c("direction2"), c("declared2"))
    return _shapes(spark, sf_dir).select("event_id", why.alias("reason"))


_DATA = "list_transform(range(0, cast(n as bigint)), lambda j: cast((seq * 31 + j * 17) % 65536 as integer))"


@query(f"with {bus.SQL_B} select seq, cast(n as integer) n_data, list_sum({_DATA})::bigint data_sum, {_DATA}[1] first_word, {_DATA}[n] last_word, status_word from b")
def payload_slice(spark, sf_dir):
    d = decoding.decode(bus.raw(spark, sf_dir))
    total = F.aggregate("data_words", F.lit(0).cast("long"), lambda a, b: a + b)
    return d.select("seq", F.col("data_word_count").alias("n_data"), total.alias("data_sum"), F.element_at("data_words", 1).alias("first_word"), F.element_at("data_words", -1).alias("last_word"), "status_word")


@query(f"with {bus.SQL_B} select seq, k = 'clean' and seq % 10 = 0 mismatch from b")
def status_anomalies(spark, sf_dir):
    return decoding.decode(bus.raw(spark, sf_dir)).select("seq", F.array_contains("anomalies", "status-rt-mismatch").alias("mismatch"))


@query(f"with {_WORDS} select event_id, lpad(upper(to_hex(w)), 4, '0') h from u")
def hex_words(spark, sf_dir):
    w, v, x = _wvx()
    return _words(spark, sf_dir).select("event_id", words.hex_word(w).alias("h"))


_CLOCK = "printf('%02d:%02d:%02d.%06d', tod // 3600000000, (tod // 60000000) % 60, (tod // 1000000) % 60, tod % 1000000)"


@query(f"with {bus.SQL_P} select seq, cast(\"day\" as varchar) || ':' || {_CLOCK} t from p")
def render_doy(spark, sf_dir):
    return bus.plain(spark, sf_dir).select("seq", render.doy(F.col("day"), F.col("tod")).alias("t"))


@query(f"with {bus.SQL_P} select seq, strftime(make_date(2023, 1, 1) + cast(\"day\" - 1 as integer), '%Y-%m-%d') || 'T' || {_CLOCK} || '-03:30' t from p")
def render_iso(spark, sf_dir):
    return bus.plain(spark, sf_dir).select("seq", render.iso(F.lit(2023), F.col("day"), F.col("tod"), render.zone_of(-210)).alias("t"))


@query(f"with {bus.SQL_P} select seq, strftime(make_date(2024, 1, 1) + cast(\"day\" * 11 as integer), '%d') || ':' || {_CLOCK} t from p")
def render_dom(spark, sf_dir):
    return bus.plain(spark, sf_dir).select("seq", render.dom(F.lit(2024), F.col("day") * 11 + 1, F.col("tod")).alias("t"))


@query(f"""with {_WORDS}, y as (select event_id, cast(1896 + w % 210 as integer) yr, cast(v % 370 as integer) doy from u)
  select event_id, case when doy >= 1 and doy <= case when yr % 4 = 0 and (yr % 100 <> 0 or yr % 400 = 0) then 366 else 365 end then cast(make_date(yr, 1, 1) + (doy - 1) as varchar) end "date" from y""")
def doy_calendar(spark, sf_dir):
    w, v, x = _wvx()
    return _words(spark, sf_dir).select("event_id", words.date_of(1896 + w % 210, v % 370).cast("string").alias("date"))


@query(f"""with {bus.SQL_P} select seq, epoch_us(make_timestamp(cast(epoch_us(cast(make_date(2024, 1, 1) + ("day" - 1) as timestamp)) as bigint) + tod - 5400000000)) us from p""")
def datetime_from_doy(spark, sf_dir):
    at = words.datetime_of(F.lit(2024), F.col("day"), F.col("tod"), 90)
    return bus.plain(spark, sf_dir).withColumn("at", at).select("seq", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', at)").alias("us"))


@query(f"with {_WORDS}, y as (select event_id, cast(w % 4000 + 1 as integer) yr from u) select event_id, yr % 4 = 0 and (yr % 100 <> 0 or yr % 400 = 0) leap from y")
def leap_guard(spark, sf_dir):
    w, v, x = _wvx()
    return _words(spark, sf_dir).select("event_id", words.leap_year(w % 4000 + 1).alias("leap"))


_NAMES = "case message_type when 2 then 'BC_TO_RT' when 4 then 'RT_TO_BC' else 'SPURIOUS_DATA' end"


@query(f"with {bus.SQL_R} select seq, file_index, time_us, error_word, follows from r")
def continuation_pairing(spark, sf_dir):
    from ..operators.pairing import is_continuation

    return bus.records(spark, sf_dir).select("seq", "file_index", "time_us", "error_word", is_continuation().alias("follows"))


@query(f"with {bus.SQL_R} select case when spurious then 'SPURIOUS' when error then 'ERROR' else '' end label, case when error_word = 288 then 'card' when error_word = 8192 then 'continuation' when error_word = 8193 then 'standalone' end code_kind, {_NAMES} type_name, case when bus = 1 then 'B' else 'A' end bus_name, count(*) n from r group by all")
def error_label_counts(spark, sf_dir):
    r = bus.records(spark, sf_dir)
    by = [words.error_label(F.col("message_type") == 32, F.col("error")).alias("label"), words.error_kind(F.col("error_word")).alias("code_kind"), words.type_name(F.col("message_type")).alias("type_name"), words.bus_name(F.col("bus")).alias("bus_name")]
    return r.groupBy(*by).agg(F.count("*").alias("n"))


@query(f"with {bus.SQL_D} select seq, delta_us, delta_us / 1e6::double delta from d")
def delta_per_file(spark, sf_dir):
    return bus.records(spark, sf_dir).select("seq", "delta_us", "delta")


_MERGE = "m as (select *, max(time_us) over (partition by file_index order by seq) merge_us from d)"
_GLOBAL = "g as (select * exclude (prev, delta_us), case when rt is null then null when prev is null then 0 when time_us >= prev then time_us - prev end delta_us from (select *, last_value(case when rt is not null then time_us end ignore nulls) over (partition by rt, subaddress, direction order by merge_us, file_index, seq rows between unbounded preceding and 1 preceding) prev from m))"


@query(f"with {bus.SQL_D}, {_MERGE}, {_GLOBAL} select seq, merge_us, delta_us from g")
def delta_global(spark, sf_dir):
    m = merge.merged(bus.records(spark, sf_dir))
    return delta.with_delta(m, "global", merge.ORDER).select("seq", "merge_us", "delta_us")


_LABEL = "case when rt is null then '' else cast(subaddress as varchar) || case when direction = 1 then 'T' else 'R' end end"


@query(f"with {bus.SQL_D} select rt, {_LABEL} msg_label, count(*) messages, cast(sum(case when error then 1 else 0 end) as bigint) errored, cast(median(delta_us) as double) median_gap_us from d where rt is not null group by 1, 2")
def delta_summary(spark, sf_dir):
    return analytics.median_gaps(bus.records(spark, sf_dir))


@query(f"""with {bus.SQL_D}, y as (select file_index, rt, subaddress, direction, seq, case when seq % 5 = 0 then time_us - 3600000000 else time_us end time_us from d where rt is not null),
  z as (select *, lag(time_us) over (partition by file_index, rt, subaddress, direction order by seq) prev from y)
  select file_index, rt, subaddress, direction, arg_min(time_us, seq) time_us, count(*) steps from z where time_us < prev group by 1, 2, 3, 4""")
def delta_backward_keys(spark, sf_dir):
    d = bus.records(spark, sf_dir).withColumn("time_us", F.when(F.col("seq") % 5 == 0, F.col("time_us") - 3600000000).otherwise(F.col("time_us")))
    return delta.backward_steps(d)


@query(f"with {bus.SQL_D}, {_MERGE} select seq, file_index, merge_us, row_number() over (partition by merge_us order by file_index, seq) place from m")
def merge_order(spark, sf_dir):
    m = merge.merged(bus.records(spark, sf_dir))
    return m.select("seq", "file_index", "merge_us", F.row_number().over(Window.partitionBy("merge_us").orderBy("file_index", "seq")).cast("long").alias("place"))


@query(f"""with {bus.SQL_D}, y as (select file_index, seq, case when seq % 11 = 0 then time_us - 7200000000 else time_us end time_us from d), z as (select *, lag(time_us) over (partition by file_index order by seq) prev from y)
  select file_index, count(*) steps, min(seq) first_seq from z where time_us < prev group by 1""")
def merge_backward_steps(spark, sf_dir):
    d = bus.records(spark, sf_dir).withColumn("time_us", F.when(F.col("seq") % 11 == 0, F.col("time_us") - 7200000000).otherwise(F.col("time_us")))
    return merge.backward_files(d)


def _copies(spark, sf_dir) -> DataFrame:
    """Records with words that recur: those of one terminal are alike."""
    r = merge.merged(bus.records(spark, sf_dir))
    same = {"type_word": F.lit(0), "command_word": F.col("rt"), "status_word": F.lit(0), "data_words": F.array(F.lit(0))}
    return r.withColumns(same)


_DUP = "h as (select *, not follows and file_index > min(file_index) over (partition by time_us, follows, rt, error_word) dup from m), i as (select *, case when follows then coalesce(lag(dup) over (partition by file_index order by seq), false) else dup end collapsed from h)"


@query(f"with {bus.SQL_D}, {_MERGE}, {_DUP} select seq, collapsed from i")
def collapse_exact(spark, sf_dir):
    return collapse.marked(_copies(spark, sf_dir)).select("seq", "collapsed")


@query(f"with {bus.SQL_D}, {_MERGE}, {_DUP} select collapsed, count(*) n from i group by 1")
def collapse_counts(spark, sf_dir):
    return collapse.marked(_copies(spark, sf_dir)).groupBy("collapsed").agg(F.count("*").alias("n"))


#: Every seventh record half an hour early, and all of one file from some time on by three hours: clocks that step back.
_BACK = """back0 as (select * exclude (time_us, merge_us), time_us - case when seq % 7 = 0 then 1800000000 else 0 end - case when file_index = 1 and seq % 1000 > 600 then 10800000000 else 0 end time_us from m),
  back as (select *, max(time_us) over (partition by file_index order by seq) merge_us from back0)"""


def _stepping(r: DataFrame) -> DataFrame:
    early = F.when(F.col("seq") % 7 == 0, 1_800_000_000).otherwise(0) + F.when((F.col("file_index") == 1) & (F.col("seq") % 1000 > 600), 10_800_000_000).otherwise(0)
    return merge.merged(r.drop("merge_us").withColumn("time_us", F.col("time_us") - early))


def _walk_sql(window: int, cap: int, records: str = "m") -> str:
    """The sequential rule, a record at a time: kept ones leave beyond the window or the cap, and one of another file with the same words makes a duplicate."""
    return f"""with recursive {bus.SQL_D}, {_MERGE}, {_BACK}, o as materialized (select row_number() over (order by merge_us, file_index, seq) i, time_us t, file_index x, seq, coalesce(rt, -1) * 100000 + coalesce(error_word, 0) w from {records} where not follows),
  walk as (select cast(0 as bigint) i, cast([] as struct(t bigint, x integer, w integer)[]) kept, false dup
    union all select i, case when dup then near when len(near) >= {cap} then list_append(near, {{'t': t, 'x': x, 'w': w}})[2:] else list_append(near, {{'t': t, 'x': x, 'w': w}}) end, dup
    from (select o.i, t, x, w, near, len(list_filter(near, lambda k: k.w = o.w and k.x <> o.x)) > 0 dup from (select walk.i, list_filter(walk.kept, lambda k: abs(k.t - n.t) <= {window}) near from walk join o n on n.i = walk.i + 1) v join o on o.i = v.i + 1)),
  h as (select m.*, coalesce(walk.dup, false) dup from {records} m left join o on o.seq = m.seq left join walk on walk.i = o.i),
  z as (select *, case when follows then coalesce(lag(dup) over (partition by file_index order by seq), false) else dup end collapsed from h) select seq, file_index, merge_us from z where not collapsed"""


@query(_walk_sql(1_200_000_000, 1 << 40))
def collapse_window(spark, sf_dir):
    return collapse.collapse(_copies(spark, sf_dir), window_us=1_200_000_000).select("seq", "file_index", "merge_us")


@query(_walk_sql(86_400_000_000, 16))
def collapse_capped(spark, sf_dir):
    return collapse.collapse(_copies(spark, sf_dir), window_us=86_400_000_000, cap=16).select("seq", "file_index", "merge_us")


@query(_walk_sql(3_600_000_000, 1 << 40, "back"))
def collapse_out_of_order(spark, sf_dir):
    return collapse.collapse(_stepping(_copies(spark, sf_dir)), window_us=3_600_000_000, monotone=False).select("seq", "file_index", "merge_us")


@query(_walk_sql(3_600_000_000, 6, "back"))
def collapse_out_of_order_capped(spark, sf_dir):
    return collapse.collapse(_stepping(_copies(spark, sf_dir)), window_us=3_600_000_000, cap=6, monotone=False).select("seq", "file_index", "merge_us")


def _filter_sql(gone: str, parent_gone: str, own_type: str) -> str:
    return f"""with {bus.SQL_D}, t as (select *, lag(k = 'err' and coalesce({parent_gone}, false)) over (partition by file_index order by seq) behind from d)
      select seq from t where not case when follows then behind or {own_type} else coalesce({gone}, false) end"""


@query(_filter_sql("rt in (1, 2, 3) or bus = 1", "rt in (1, 2, 3) or bus = 1", "false"))
def filter_exclude(spark, sf_dir):
    return filters.apply_filters(bus.records(spark, sf_dir), filters.Filters(exclude_rts=(1, 2, 3), exclude_buses=(1,))).select("seq")


@query(_filter_sql("not coalesce(subaddress in (4, 5, 6, 7), false) or not message_type in (2, 32)", "not coalesce(subaddress in (4, 5, 6, 7), false)", "false"))
def filter_include(spark, sf_dir):
    f = filters.Filters(include_subaddresses=(4, 5, 6, 7), include_types=(2, 32))
    return filters.apply_filters(bus.records(spark, sf_dir), f).select("seq")


@query(_filter_sql("rt in (1, 2, 3, 4, 5, 6, 7, 8) or message_type = 32", "rt in (1, 2, 3, 4, 5, 6, 7, 8)", "true"))
def filter_follow_parent(spark, sf_dir):
    f = filters.Filters(exclude_rts=tuple(range(1, 9)), exclude_types=(32,))
    return filters.apply_filters(bus.records(spark, sf_dir), f).select("seq")


#: A record and its time, which is its run where times never come back.
_BY_TIME = "a as (select seq i, time_us ts, rt * 64 + subaddress * 2 + direction k from d)"
#: The same where clocks step back: a run ends where the time changes.
_BY_RUN = """a0 as (select seq i, time_us - case when seq % 7 = 0 then 1800000000 else 0 end - case when file_index = 1 and seq % 1000 > 600 then 10800000000 else 0 end t, rt * 64 + subaddress * 2 + direction k from d),
  a1 as (select *, case when t is distinct from lag(t) over (order by i) then 1 else 0 end new from a0), a as (select i, k, cast(sum(new) over (order by i) as bigint) ts from a1)"""


def _order_sql(cap: int, records: str = _BY_TIME, out: str = "") -> str:
    return f"""with {bus.SQL_D}, {records},
  f0 as (select ts, arg_min(k is null, i) fnull, min(i) fi from a group by ts), nx as (select ts, fi, coalesce(lead(fnull) over (order by fi), false) nextnull from f0),
  b1 as (select a.*, nx.fi, nx.nextnull, (row_number() over (partition by a.ts order by i) - 1) // {cap} seg from a join nx on a.ts = nx.ts),
  c1 as (select *, count(*) over (partition by ts, seg) n, sum(case when k is null then 0 else 1 end) over (partition by ts, seg order by i) chunk, max(seg) over (partition by ts) lastseg from b1),
  d1 as (select *, case when chunk > 0 then first_value(k) over (partition by ts, seg, chunk order by i) end ak, max(chunk) over (partition by ts, seg) lastc from c1),
  e1 as (select *, max(ak) over (partition by ts, seg) mk, max(case when chunk = lastc then ak end) over (partition by ts, seg) lk from d1),
  g1 as (select *, (n = {cap} or (nextnull and seg = lastseg and coalesce(mk, -1) <> coalesce(lk, -1))) arrival from e1)
  select i seq, {out} row_number() over (partition by ts order by seg, (case when arrival then null else ak end) nulls first, (case when arrival then 0 else chunk end), i) place from g1"""


def _ordered(spark, sf_dir, cap: int, monotone: bool = True) -> DataFrame:
    r = bus.records(spark, sf_dir)
    # the view's events are one stream in order of time: continuations come up to ten minutes late, so times are cut again
    o = order.order_rows(r, cap, ("seq",), (), monotone)
    place = F.row_number().over(Window.partitionBy("time_us").orderBy(*order.sort_columns()[1:]))
    return o.select("seq", place.cast("long").alias("place"))


@query(_order_sql(65536))
def order_canonical(spark, sf_dir):
    return _ordered(spark, sf_dir, 65536)


@query(_order_sql(3))
def order_capped(spark, sf_dir):
    return _ordered(spark, sf_dir, 3)


def _in_runs(spark, sf_dir, cap: int) -> DataFrame:
    # what order_rows looks at: it writes its rows once, and they would go with all their words
    r = _stepping(bus.records(spark, sf_dir)).select("seq", "time_us", "ticks", "rt", "subaddress", "direction")
    o = order.order_rows(r, cap, ("seq",), (), monotone=False)
    place = F.row_number().over(Window.partitionBy("order_run").orderBy(*order.sort_columns()[1:]))
    return o.select("seq", F.col("order_run").alias("run"), place.cast("long").alias("place"))


@query(_order_sql(65536, _BY_RUN, "ts run,"))
def order_out_of_order(spark, sf_dir):
    return _in_runs(spark, sf_dir, 65536)


@query(_order_sql(2, _BY_RUN, "ts run,"))
def order_out_of_order_capped(spark, sf_dir):
    return _in_runs(spark, sf_dir, 2)


@query(_order_sql(1))
def order_off(spark, sf_dir):
    return _ordered(spark, sf_dir, 1)


@query(f"with {bus.SQL_D} select seq, rt, {_LABEL} msg_label from d where not spurious and not error")
def split_main(spark, sf_dir):
    return sink.split_rows(bus.records(spark, sf_dir))[0].select("seq", "rt", "msg_label")


@query(f"with {bus.SQL_D} select seq, error_word from d where spurious or error")
def split_errors(spark, sf_dir):
    return sink.split_rows(bus.records(spark, sf_dir))[1].select("seq", "error_word")


def _csv_sql() -> str:
    hexed = lambda e: f"lpad(upper(to_hex({e})), 4, '0')"
    wd = ", ".join(f"coalesce({hexed(f'dw[{i}]')}, '') WD{i:02d}" for i in range(1, 33))
    clock = _CLOCK.replace("tod", "(time_us % 86400000000)")
    return f"""with {bus.SQL_D}, c as (select *, {_DATA} dw from d)
      select cast(time_us // 86400000000 as varchar) || ':' || {clock} TIME_STAMP, coalesce(cast(rt as varchar), '') RT, {_LABEL} MSG, {wd}, coalesce({hexed('status_word')}, '') STAT, coalesce({hexed('command_word')}, '') CMD, 'BUS' MUX, '' TERM_NAME,
      case when bus = 1 then 'B' else 'A' end BUS, coalesce(printf('%d.%06d', delta_us // 1000000, delta_us % 1000000), '') "DELTA", '' IM_GAP, '' RCV_GAP, '' XMT_GAP,
      case when spurious then 'SPURIOUS' when error then 'ERROR' else '' end "ERROR", coalesce({hexed('error_word')}, '') ERROR_CODE from c"""


@query(_csv_sql())
def csv_row_46(spark, sf_dir):
    return sink.csv_rows(bus.records(spark, sf_dir))


@query(f"select count(*) n from ({SQL['filter_exclude']})")
def count_filtered(spark, sf_dir):
    from ..config import Config
    from .recordings import counted

    return counted(bus.records(spark, sf_dir), Config(filters=filters.Filters(exclude_rts=(1, 2, 3), exclude_buses=(1,))))


@query(f"with {bus.SQL_D} select rt, count(*) messages, cast(sum(case when error then 1 else 0 end) as bigint) errored from d where rt is not null group by rt")
def per_rt_counts(spark, sf_dir):
    return analytics.per_rt(bus.records(spark, sf_dir))


@query(f"with {bus.SQL_D} select rt, {_LABEL} msg_label, count(*) messages from d where rt is not null group by 1, 2 order by messages desc, rt, msg_label limit 3")
def top_rt_msg(spark, sf_dir):
    return analytics.top_messages(bus.records(spark, sf_dir), 3)


@query(f"with {bus.SQL_D} select rt, count(*) messages, max(time_us) - min(time_us) span_us, cast(count(*) as double) / nullif(max(time_us) - min(time_us), 0) * 1e6::double per_second from d where rt is not null group by rt")
def rate_per_rt(spark, sf_dir):
    return analytics.rates(bus.records(spark, sf_dir))


@query(f"with {bus.SQL_D} select file_index, seq, time_us, {_DATA}[3] \"value\" from d where rt = 1 and subaddress = 3 and direction = 0 and n >= 3")
def word_at(spark, sf_dir):
    return analytics.word_series(bus.records(spark, sf_dir), 1, 3, 0, 2)


@query(f"with {bus.SQL_D} select count(*) n_rows, cast(sum(rt) as bigint) rt_sum from d")
def rt_fingerprint(spark, sf_dir):
    return analytics.fingerprint(bus.records(spark, sf_dir))


@query(f"with {bus.SQL_D} select seq * 128 file_offset, list_transform(range(0, 32), lambda j: cast(case when j < n then (seq * 31 + j * 17) % 65536 else 0 end as integer)) data_words from d")
def columns_padded_words(spark, sf_dir):
    return cols.columns(bus.records(spark, sf_dir), ["file_offset", "data_words"], padded=True)


@query(f"with {bus.SQL_D} select seq * 128 file_offset, coalesce(rt, -1) rt, coalesce(status_word, -1) status_word, cast(coalesce(delta_us / 1e6::double, 'nan'::double) as double) delta from d")
def columns_sentinels(spark, sf_dir):
    return cols.columns(bus.records(spark, sf_dir), ["file_offset", "rt", "status_word", "delta"], sentinels=True)


byte_queries.register(query)
