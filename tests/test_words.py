import pytest
from pyspark.sql import functions as F

from busloom.errors import ConfigError
from busloom.functions import render, words


def test_all_words(spark):
    got = spark.range(65536).select(F.col("id").cast("int").alias("w")).select("w", words.type_code(F.col("w")).alias("code"), words.type_bus(F.col("w")).alias("bus"), words.type_word_count(F.col("w")).alias("n"), words.type_error(F.col("w")).alias("e"), words.command_rt(F.col("w")).alias("rt"), words.command_direction(F.col("w")).alias("d"), words.command_subaddress(F.col("w")).alias("sa"), words.command_count(F.col("w")).alias("c"), words.hex_word(F.col("w")).alias("h"), words.pack_type_word(words.type_code(F.col("w")), words.type_bus(F.col("w")), words.type_word_count(F.col("w")), words.type_error(F.col("w")).cast("int")).alias("p")).collect()
    for r in got:
        w = r.w
        assert (r.code, r.bus, r.n, r.e, r.rt, r.d, r.sa, r.c, r.h, r.p) == (w & 127, w >> 7 & 1, w >> 8 & 63, bool(w >> 14 & 1), w >> 11, w >> 10 & 1, w >> 5 & 31, w & 31 or 32, f"{w:04X}", w & 0x7FFF)


@pytest.mark.parametrize("year", [1900, 2000, 2023, 2024, 9999, 1])
def test_days(spark, year):
    import datetime

    got = spark.range(400).select(F.col("id").cast("int").alias("d"), words.date_of(F.lit(year), F.col("id").cast("int")).alias("at")).collect()
    for r in got:
        try:
            want = datetime.date(year, 1, 1) + datetime.timedelta(days=r.d - 1) if r.d >= 1 else None
        except OverflowError:
            want = None
        assert r.at == (want if want and want.year == year else None)


def test_rates_and_renderings(spark):
    one = spark.range(1)
    row = one.select(
        words.ticks_to_us(F.lit(2**32 - 1), 1e-9).alias("huge"), words.ticks_to_us(F.lit(3), float("nan")).alias("nan"), words.ticks_to_us(F.lit(1), 2e6).alias("half"), render.counter(F.lit(100000)).alias("c"), render.counter(F.lit(None)).alias("n"),
        render.seconds6(F.lit(1_000_007)).alias("s"), render.doy(F.lit(7), F.lit(86_399_999_999)).alias("t"), render.dom(F.lit(2023), F.lit(366), F.lit(0)).alias("none"), words.datetime_of(F.lit(2024), F.lit(1), F.lit(0), 60).cast("string").alias("shift"),
    ).first()
    assert (row.huge, row.nan, row.half, row.c, row.n, row.s, row.t, row.none, row["shift"]) == (None, None, 1, "0x000186A0", None, "1.000007", "7:23:59:59.999999", None, "2023-12-31 23:00:00")


def test_zones():
    assert [render.parse_offset(x) for x in ("Z", "z", "+05:30", "-00:15")] == [0, 0, 330, -15]
    assert [render.zone_of(m) for m in (0, 330, -15)] == ["Z", "+05:30", "-00:15"]
    for bad in ("", "5:30", "+24:00", "+00:60", "+0530", "+٠٥:٣٠"):
        with pytest.raises(ConfigError):
            render.parse_offset(bad)
    assert render.printable("a\né") == "a\\n\\u00e9"
