"""Times and cells as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError
from .words import date_of


def _digits(n: Column, width: int) -> Column:
    return F.lpad(n.cast("long").cast("string"), width, "0")


def clock(of_day_us: Column) -> Column:
    """HH:MM:SS.uuuuuu"""
    s = F.floor(of_day_us / 1_000_000)
    return F.concat(_digits(F.floor(s / 3600), 2), F.lit(":"), _digits(F.floor(s / 60) % 60, 2), F.lit(":"), _digits(s % 60, 2), F.lit("."), _digits(of_day_us % 1_000_000, 6))


def doy(day: Column, of_day_us: Column) -> Column:
    return F.concat(day.cast("string"), F.lit(":"), clock(of_day_us))


def iso(year: Column, day: Column, of_day_us: Column, zone: str = "Z") -> Column:
    """The civil time as recorded; the zone is a label and shifts nothing."""
    return F.concat(F.date_format(date_of(year, day), "yyyy-MM-dd"), F.lit("T"), clock(of_day_us), F.lit(zone))


def dom(year: Column, day: Column, of_day_us: Column) -> Column:
    return F.concat(F.date_format(date_of(year, day), "dd"), F.lit(":"), clock(of_day_us))


def counter(ticks: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(ticks.cast("long")), 8, "0"))


def zone_of(minutes: int) -> str:
    return "Z" if not minutes else f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def parse_offset(text: str) -> int:
    """Minutes of 'Z' or of a sign and HH:MM."""
    if text in ("Z", "z"):
        return 0
    m = re.fullmatch(r"([+-])([0-9]{2}):([0-9]{2})", text, re.A)
    if not m or int(m[2]) > 23 or int(m[3]) > 59:
        raise ConfigError(f"utc offset {text!r}: Z, or a sign and HH:MM to 23:59")
    return (-1 if m[1] == "-" else 1) * (int(m[2]) * 60 + int(m[3]))


def seconds6(us: Column) -> Column:
    """A count of microseconds as seconds with six decimals, by integers alone."""
    return F.concat(F.when(us < 0, "-").otherwise(""), F.floor(F.abs(us) / 1_000_000).cast("string"), F.lit("."), _digits(F.abs(us) % 1_000_000, 6))


def printable(text: str) -> str:
    """Text for diagnostics: ASCII as it is, the rest and control characters escaped."""
    return "".join(c if " " <= c <= "~" else c.encode("unicode_escape").decode("ascii") if c < "\x80" or ord(c) > 0xFFFF else f"\\u{ord(c):04x}" for c in text)
