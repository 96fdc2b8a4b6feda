"""Raw rows to typed records: classification, payload, rejections. One projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import render, words
from ..schema import MAX_DATA_WORDS, SPURIOUS_FORMAT, SPURIOUS_TYPE


def mode_code_format(rt: Column, direction: Column, count: Column, ts_words: Column) -> Column:
    """Format of a mode command by the room it has for a data word."""
    broadcast = F.when(count >= ts_words + 3, 10).otherwise(9)
    plain = F.when(count >= ts_words + 4, F.when(direction == 1, 6).otherwise(7)).otherwise(8)
    return F.when(words.is_broadcast(rt), broadcast).otherwise(plain)


def message_format(code: Column, rt: Column, direction: Column, count: Column, ts_words: Column) -> Column:
    plain = {0x02: 1, 0x04: 2, 0x08: 3, 0x10: 4, 0x18: 5, 0x20: SPURIOUS_FORMAT}
    out = F.when(code == 0x01, mode_code_format(rt, direction, count, ts_words))
    for c, f in plain.items():
        out = out.when(code == c, f)
    return out


def least_payload(fmt: Column, declared: Column) -> Column:
    """Words that a format needs after the command word."""
    return F.when(fmt.isin(1, 2), declared + 1).when(fmt == 3, declared + 3).when(fmt == 4, declared).when(fmt == 5, declared + 2).when(fmt.isin(6, 7), 2).when(fmt.isin(8, 10), 1).otherwise(0)


def reject_reason(code: Column, direction: Column, count: Column, fmt: Column, declared: Column, ts_words: Column, direction2: Column, declared2: Column) -> Column:
    """Why a record without error flag is rejected; null if it isn't. In the order of the checks."""
    pair = fmt.isin(3, 5)
    return (
        F.when((code == 0x02) & (direction != 0), "direction-bc-to-rt")
        .when((code == 0x04) & (direction != 1), "direction-rt-to-bc")
        .when(count < ts_words + 2 + least_payload(fmt, declared), "word-count-capacity")
        .when(pair & (direction2 != 0), "direction-second-command")
        .when(pair & (declared != declared2), "data-word-count-mismatch")
    )


def _words(body: Column, start: Column, n: Column) -> Column:
    """n words of body from start (0-based), or none if they run past its end."""
    n = F.least(n, F.lit(MAX_DATA_WORDS))
    return F.when((n > 0) & (start + n <= F.size(body)), F.slice(body, start + 1, n)).otherwise(F.array().cast("array<int>"))


def decode(raw: DataFrame, *, tick_rate_hz: float | None = None, began: Column | None = None) -> DataFrame:
    """Typed columns of raw rows. Markers stay, with kind 'resync'; rejected records become kind 'skip' with a reject_reason.

    Status rows are left out. Where the source tells what is known from earlier records, stamp_us, prev_us and merge_us hold it in
    microseconds. Besides the public fields (but delta, and the texts of with_times) there are file_index, source_path, seq, kind, type_word,
    word_count, reject_reason, anomalies and raw_time_us, the time as stamped on the record itself.

    began: the ticks that had passed when a file began, as its catalogue tells. A counter has 32 bits and wraps; with began, counters go on
    from it for another 1 << 32 ticks.
    """
    r = raw.filter("kind <> 'status'")
    tw, body = F.col("type_word"), F.col("body")
    irig = F.col("ts_format") == "irig"
    rec = F.col("kind") == "rec"
    r = r.withColumns({"message_type": words.type_code(tw), "bus": words.type_bus(tw), "word_count": words.type_word_count(tw), "error": words.type_error(tw), "ts_words": F.when(irig, 3).otherwise(2)})
    spurious = F.col("message_type") == SPURIOUS_TYPE
    cmd = F.when(rec & ~spurious, F.get(body, F.lit(0)))
    r = r.withColumn("command_word", cmd)
    cw = F.col("command_word")
    r = r.withColumns({"rt": words.command_rt(cw), "subaddress": words.command_subaddress(cw), "direction": words.command_direction(cw), "declared": words.command_count(cw)})
    r = r.withColumn("message_format", message_format(F.col("message_type"), F.col("rt"), F.col("direction"), F.col("word_count"), F.col("ts_words")))
    fmt = F.col("message_format")
    errored = F.col("error") & ~spurious
    second = F.when(fmt.isin(3, 5) & ~errored, F.coalesce(F.get(body, F.lit(1)), F.lit(0)))
    r = r.withColumn("command_word_2", second).withColumn("declared_2", words.command_count(F.col("command_word_2")))
    n, n2 = F.col("declared"), F.col("declared_2")
    at = lambda i: F.get(body, i if isinstance(i, Column) else F.lit(i))
    status = F.when(errored, None).when(fmt == 1, at(n + 1)).when(fmt.isin(2, 6, 8), at(1)).when(fmt.isin(3, 5), at(2)).when(fmt == 7, at(2))
    status_2 = F.when(~errored & (fmt == 3), at(n2 + 3))
    data = (
        F.when(spurious, F.slice(body, 1, MAX_DATA_WORDS))
        .when(errored, _words(body, F.lit(1), F.size(body) - 2))
        .when(fmt.isin(1, 4), _words(body, F.lit(1), n))
        .when(fmt == 2, _words(body, F.lit(2), n))
        .when(fmt.isin(3, 5), _words(body, F.lit(3), n2))
        .when(fmt == 6, _words(body, F.lit(2), F.lit(1)))
        .when(fmt.isin(7, 10), _words(body, F.lit(1), F.lit(1)))
        .otherwise(F.array().cast("array<int>"))
    )
    short = errored & (F.col("word_count") < F.col("ts_words") + 3)
    plain = reject_reason(F.col("message_type"), F.col("direction"), F.col("word_count"), fmt, n, F.col("ts_words"), words.command_direction(F.col("command_word_2")), n2)
    why = F.when(rec, F.when(short, "no-error-word").when(~spurious & ~errored, plain))
    up, mid, low = F.col("t0"), F.col("t1"), F.col("t2")
    of_day = words.time_of_day_us(words.irig_hour(up), words.irig_minute(mid), words.irig_second(mid), words.irig_micros(mid, low))
    r = r.withColumns({
        "status_word": status, "status_word_2": status_2, "data_words": F.when(rec, data), "error_word": F.when(errored, F.element_at(body, -1)), "reject_reason": why,
        "freerun": F.when(irig, words.irig_freerun(up)), "day_of_year": F.when(irig, words.irig_day(up)).cast("smallint"), "time_of_day_us": F.when(irig, of_day), "ticks": F.when(~irig, words.led_on(words.standard_ticks(up, mid), began)),
    })
    day, tod = F.col("day_of_year"), F.col("time_of_day_us")
    r = r.withColumn("raw_time_us", F.when(rec, F.coalesce(words.total_us(day, tod), words.ticks_to_us(F.col("ticks"), tick_rate_hz))))
    anomalies = F.array_compact(F.array(F.when(words.status_rt(F.col("status_word")) != F.col("rt"), F.lit("status-rt-mismatch")), F.when(words.type_reserved(tw), F.lit("reserved-bit"))))
    kind = F.when(F.col("reject_reason").isNotNull(), "skip").otherwise(F.col("kind"))
    r = r.withColumns({"kind": kind, "time_us": F.col("raw_time_us"), "anomalies": F.when(rec & ~errored & ~spurious, anomalies).otherwise(F.array().cast("array<string>")), "msg_label": words.message_label(F.col("subaddress"), F.col("direction")), "data_word_count": F.size("data_words"), "detail": F.coalesce("reject_reason", "detail")})
    if "stamp" in raw.columns:
        us = lambda c: F.when(irig, F.col(c)).otherwise(words.ticks_to_us(words.led_on(F.col(c), began), tick_rate_hz))
        r = r.withColumns({"stamp_us": us("stamp"), "prev_us": us("prev_stamp"), "merge_us": us("high")}).drop("stamp", "prev_stamp", "high")
    if began is not None:
        r = r.withColumn("ticks_began", began)  # for the times of parents
    return r.drop("t0", "t1", "t2", "body", "declared", "declared_2", "ts_words")


def with_times(df: DataFrame, *, year: int | None = None, utc_offset: int = 0, time_format: str = "doy") -> DataFrame:
    """df with timestamp (text) and datetime, from its day, time of day and counter."""
    day, tod = F.col("day_of_year"), F.col("time_of_day_us")
    if time_format == "doy":
        text = render.doy(day, tod)
    else:
        y = F.lit(year).cast("int")
        text = render.iso(y, day, tod, render.zone_of(utc_offset)) if time_format == "iso" else render.dom(y, day, tod)
        text = F.when(F.col("freerun"), None).otherwise(text)
    when = words.datetime_of(F.lit(year).cast("int"), day, tod, utc_offset) if year is not None else F.lit(None).cast("timestamp_ntz")
    return df.withColumns({"timestamp": F.coalesce(text, render.counter(F.col("ticks"))) if time_format == "doy" else text, "datetime": F.when(~F.col("freerun"), when)})


def first_rejects(decoded: DataFrame) -> DataFrame:
    """file_index and seq of each file's first rejected record, or unknown error code: where strict reading stops."""
    bad = (F.col("kind") == "skip") | (F.col("kind") == "rec") & F.col("error") & (F.col("message_type") != SPURIOUS_TYPE) & ~words.is_known_error(F.col("error_word"))
    return decoded.filter(bad).groupBy("file_index").agg(F.min_by(F.struct("seq", "file_offset", F.coalesce("reject_reason", F.lit("unknown-error-code")).alias("reason")), "seq").alias("stop")).select("file_index", "stop.*")
