"""Bit fields of 16-bit words, and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CARD_ERROR_CODES, CONTINUATION, MESSAGE_TYPES, MICROS_PER_DAY, STANDALONE


def bits(word: Column, low: int, width: int) -> Column:
    shifted = F.shiftright(word, low) if low else word
    return shifted.bitwiseAND(F.lit((1 << width) - 1))


def type_code(word: Column) -> Column:
    return bits(word, 0, 7)


def type_bus(word: Column) -> Column:
    return bits(word, 7, 1)


def type_word_count(word: Column) -> Column:
    return bits(word, 8, 6)


def type_error(word: Column) -> Column:
    return bits(word, 14, 1) == 1


def type_reserved(word: Column) -> Column:
    return bits(word, 15, 1) == 1


def pack_type_word(code: Column, bus: Column, count: Column, error: Column) -> Column:
    """A type word from its fields; null if one is too wide."""
    fits = code.between(0, 127) & bus.between(0, 1) & count.between(0, 63) & error.between(0, 1)
    word = code.bitwiseOR(F.shiftleft(bus, 7)).bitwiseOR(F.shiftleft(count, 8)).bitwiseOR(F.shiftleft(error, 14))
    return F.when(fits, word)


def command_rt(word: Column) -> Column:
    return bits(word, 11, 5)


def command_direction(word: Column) -> Column:
    return bits(word, 10, 1)


def command_subaddress(word: Column) -> Column:
    return bits(word, 5, 5)


def command_count(word: Column) -> Column:
    n = bits(word, 0, 5)
    return F.when(n == 0, 32).otherwise(n)


def status_rt(word: Column) -> Column:
    return bits(word, 11, 5)


def irig_day(upper: Column) -> Column:
    return bits(upper, 5, 9)


def irig_hour(upper: Column) -> Column:
    return bits(upper, 0, 5)


def irig_freerun(upper: Column) -> Column:
    return bits(upper, 15, 1) == 1


def irig_minute(middle: Column) -> Column:
    return bits(middle, 10, 6)


def irig_second(middle: Column) -> Column:
    return bits(middle, 4, 6)


def irig_micros(middle: Column, lower: Column) -> Column:
    return F.shiftleft(bits(middle, 0, 4), 16).bitwiseOR(lower)


def time_of_day_us(hour: Column, minute: Column, second: Column, micros: Column) -> Column:
    return (hour.cast("long") * 3600 + minute * 60 + second) * 1_000_000 + micros


def total_us(day: Column, of_day: Column) -> Column:
    return day.cast("long") * MICROS_PER_DAY + of_day


def standard_ticks(upper: Column, lower: Column) -> Column:
    """The 32-bit counter, as a long since an int would turn negative."""
    return F.shiftleft(upper.cast("long"), 16).bitwiseOR(lower.cast("long"))


def led_on(ticks: Column, began: Column | None) -> Column:
    """Ticks since the clock was set, from a 32-bit counter that may have wrapped: the first such number from began on. As it stands without began."""
    return ticks if began is None else began + F.pmod(ticks - began, F.lit(1 << 32))


def ticks_to_us(ticks: Column, hz: float | None) -> Column:
    """Microseconds of a counter, half away from zero; null without a usable rate or beyond a signed long."""
    if hz is None or not 0 < hz < float("inf"):
        return F.lit(None).cast("long")
    us = F.round(ticks.cast("double") * 1e6 / F.lit(float(hz)))
    return F.when(us < float(2**63), us.cast("long"))


def message_label(subaddress: Column, direction: Column) -> Column:
    return F.coalesce(F.concat(subaddress.cast("string"), F.when(direction == 1, "T").otherwise("R")), F.lit(""))


def delta_key(rt: Column, subaddress: Column, direction: Column) -> Column:
    return F.concat(rt.cast("string"), F.lit(":"), subaddress.cast("string"), F.lit("["), F.when(direction == 1, "T").otherwise("R"), F.lit("]"))


def is_mode_code(subaddress: Column) -> Column:
    return subaddress.isin(0, 31)


def is_broadcast(rt: Column) -> Column:
    return rt == 31


def is_known_error(code: Column) -> Column:
    return code.isin(*CARD_ERROR_CODES)


def error_kind(code: Column) -> Column:
    return F.when(code.isin(*CARD_ERROR_CODES), "card").when(code == CONTINUATION, "continuation").when(code == STANDALONE, "standalone").when(code.isNotNull(), "unknown")


def error_label(spurious: Column, error: Column) -> Column:
    return F.when(spurious, "SPURIOUS").when(error, "ERROR").otherwise("")


def bus_name(bus: Column) -> Column:
    return F.when(bus == 1, "B").otherwise("A")


def type_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in MESSAGE_TYPES.items() for x in kv))
    return F.element_at(names, code)


def hex_word(word: Column) -> Column:
    return F.lpad(F.hex(word.cast("long")), 4, "0")


def leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def date_of(year: Column, day_of_year: Column) -> Column:
    """The date of a day of a year; null if the year has no such day."""
    most = F.when(leap_year(year), 366).otherwise(365)
    day = F.when(day_of_year.between(1, most), day_of_year)
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day.cast("int") - 1)


def datetime_of(year: Column, day_of_year: Column, of_day_us: Column, offset_minutes: int = 0) -> Column:
    """The UTC time (without zone) of a civil time that is offset_minutes ahead of UTC."""
    days = F.datediff(date_of(year, day_of_year), F.lit("1970-01-01").cast("date")).cast("long")
    us = days * MICROS_PER_DAY + of_day_us - offset_minutes * 60_000_000
    # counted from an epoch without zone, so the session's zone plays no part
    seconds = (F.pmod(us, F.lit(MICROS_PER_DAY)).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)")
    step = F.make_dt_interval(F.floor(us / MICROS_PER_DAY).cast("int"), F.lit(0), F.lit(0), seconds)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + step
