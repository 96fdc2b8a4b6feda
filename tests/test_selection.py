import random

import pytest
from pyspark.sql import functions as F

from busloom.config import Config
from busloom.operators import filters
from busloom.operators.filters import Filters
from busloom.plans import recordings as plans
from busloom.sources import recording
from busloom.sources.framing import Options
from busloom.sources.selection import Selection

from . import recordings as R
from .test_recordings import put

MARKS = ("file_index", "seq")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(recording, "LEAST_PIECE", 2000)
    monkeypatch.setattr(recording, "MOST_PIECE", 2000)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    return [put(folder, f"s{i}", R.random_recording(700 + i, 300, damage)) for i, damage in enumerate((0, 3, 9))]


@pytest.fixture(scope="module")
def pieces(spark, files):
    return [p for f in recording.survey_files(spark, files, Options("irig"), 4000) for p in f.pieces]


@pytest.fixture(scope="module")
def every(spark, pieces):
    out = plans.records(recording.read_pieces(spark, pieces)).persist()
    yield out
    out.unpersist()


@pytest.fixture(scope="module")
def scanned(spark, pieces):
    out = recording.scan(spark, pieces).persist()
    yield out
    out.unpersist()


def pieces_of(spark, files, **options):
    return [p for f in recording.surveyed(spark, files, input_time_format="irig", **options) for p in f.pieces]


def told(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


SOME = [
    Filters(exclude_types=(0x02, 0x20)), Filters(exclude_types=(0x04,)), Filters(include_types=(0x20,)), Filters(include_rts=(1, 2, 3)), Filters(exclude_rts=tuple(range(20))),
    Filters(include_buses=(1,), exclude_subaddresses=(2, 3, 4)), Filters(include_types=(0x02, 0x20), include_subaddresses=(1, 5, 9), exclude_buses=(0,)), Filters(exclude_rts=tuple(range(32))),
]


@pytest.mark.parametrize("which", range(len(SOME)))
def test_what_the_source_leaves_is_what_filters_leave(spark, pieces, every, which):
    """Continuations go with their parents, and what is told of earlier records is told as if all were there."""
    f = SOME[which]
    at_source = plans.records(recording.read_pieces(spark, pieces, Selection.of(f)))
    after = filters.apply_filters(every, f)
    columns = (*MARKS, "time_us", "message_type", "rt", "data_words", "error_word", "delta_us", "merge_us", "back")
    assert told(at_source, *columns) == told(after, *columns)


def test_random_filters(spark, pieces, every):
    r = random.Random(4)
    some = lambda top, most: tuple(r.sample(range(top), r.randrange(1, most)))
    for _ in range(8):
        f = Filters(**{k: v for k, v in {
            "exclude_types": tuple(r.sample([1, 2, 4, 8, 16, 24, 32], 2)), "include_types": tuple(r.sample([1, 2, 4, 8, 16, 24, 32], 5)), "exclude_rts": some(32, 20), "include_rts": some(32, 25),
            "exclude_subaddresses": some(32, 20), "include_subaddresses": some(32, 25), "include_buses": (r.randrange(2),), "exclude_buses": (r.randrange(2),),
        }.items() if r.random() < 0.35})
        if f.active:
            assert told(plans.records(recording.read_pieces(spark, pieces, Selection.of(f))), *MARKS, "delta_us") == told(filters.apply_filters(every, f), *MARKS, "delta_us")


def opened(df):
    """Tasks that read something: partitions of the scan."""
    return df.rdd.getNumPartitions()


def test_a_range_of_time_opens_only_pieces_that_overlap(spark, tmp_path, small):
    raw = b"".join(R.record("receive", R.irig(i * 1000), rt=i % 30, n=10) for i in range(4000)) + R.END
    path = put(tmp_path, "long", raw)
    pieces = pieces_of(spark, [path])
    assert len(pieces) > 30
    start = 10 * 86_400_000_000
    low, high = start + 1_000_000, start + 1_100_000
    some = recording.read_pieces(spark, pieces, Selection.of(None, low, high))
    assert opened(some) <= 4 and some.count() == 100
    got = plans.table(spark, [path], ["time_us", "rt"], Config(input_time_format="irig"), since_us=low, until_us=high)
    assert [r.time_us for r in got.collect()] == list(range(low, high, 1000))
    assert recording.read_pieces(spark, pieces, Selection.of(None, 0, 5)).count() == 0  # no piece at all
    gone = [p for p in pieces if not Selection.of(Filters(include_rts=(31,))).may_hold(recording.Zone(**p.zone), "irig")]
    assert len(gone) == len(pieces)


def test_counters_have_no_range_at_the_source(spark, tmp_path, small):
    """Their time hangs on a rate, which the source doesn't know: all pieces are opened, and the rows are right."""
    path = put(tmp_path, "c", b"".join(R.record("transmit", R.standard(1000 * i), rt=3, n=3) for i in range(600)) + R.END)
    got = plans.table(spark, [path], ["time_us"], Config(input_time_format="standard", standard_tick_rate_hz=1e6), since_us=5000, until_us=9000)
    assert [r.time_us for r in got.collect()] == [5000, 6000, 7000, 8000]


@pytest.mark.parametrize("where", [
    "kind = 'rec'", "rt = 3", "rt in (1, 2, 40)", "not rt = 3", "rt not in (1, 2)", "rt > 3 and rt <= 9", "not rt < 4", "message_type = 32 and kind = 'rec'", "bus <> 1", "subaddress >= 30",
    "rt is null", "rt is not null", "stamp between 0 and 9223372036854775806", "rt = 3 or bus = 1", "rt + 1 = 4", "rt <=> 3", "rt in (1, null)", "kind = 'resync'", "rt = -5", "subaddress < 0", "rt = 3 and size(body) > 4",
])
def test_plain_filters_reach_the_source(spark, pieces, scanned, where):
    columns = (*MARKS, "kind", "detail", "rt", "bus", "subaddress", "message_type", "prev_stamp", "high", "body")
    want = told(scanned.filter(where), *columns)
    spark.conf.set(recording.PUSHDOWN, "true")
    try:
        fast = recording.scan(spark, pieces).filter(where)
        assert told(fast, *columns) == want
        plan = fast._jdf.queryExecution().executedPlan().toString()
        if where in ("rt = 3", "rt in (1, 2, 40)", "kind = 'rec'", "not rt = 3", "rt > 3 and rt <= 9"):
            assert "Filter (" not in plan.replace("PushedFilters", "")  # nothing is left for Spark to look at
        early = min(p.zone["low"] for p in pieces if p.zone)
        assert opened(recording.scan(spark, pieces).filter(F.col("stamp") < early + 3000)) < len(pieces)
    finally:
        spark.conf.unset(recording.PUSHDOWN)


def test_count_with_filters(spark, files):
    c = Config(input_time_format="irig", filters=Filters(exclude_types=(2,), exclude_rts=(5, 6)))
    assert plans.count(spark, files[1], c) == plans.counted(plans.records(plans.raw(spark, [files[1]], c), c), c).first().n


def test_merges_with_filters(spark, tmp_path, small):
    paths = [put(tmp_path, f"m{i}", b"".join(R.record("receive", R.irig(i * 7 + j * 50), rt=j % 7, n=4) for j in range(300)) + R.END) for i in range(2)]
    for c in (Config(filters=Filters(include_rts=(2, 3))), Config(filters=Filters(include_rts=(2, 3)), delta_scope="global"), Config(filters=Filters(include_rts=(2, 3)), collapse_duplicates=True, collapse_window_us=10)):
        a = plans.analysis(spark, paths, c)  # filtered after all else
        want = told(a.records, "time_us", "rt", "file_index", "delta_us")
        assert told(plans.analysis(spark, paths, c, push=True).records, "time_us", "rt", "file_index", "delta_us") == want and want
