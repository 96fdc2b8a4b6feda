import random

import pytest

from busloom.plans import recordings as plans
from busloom.sources import growing
from busloom.sources.facts import Carry
from busloom.sources.framing import SCAN_BYTES, Framer, Options
from busloom.sources.recording import batches

from . import recordings as R
from .test_recordings import rows_of

COLUMNS = ("file_index", "seq", "kind", "file_offset", "time_us", "rt", "data_words", "error_word", "delta_us", "merge_us", "back")


def steps(raw, cuts, **more):
    """Rows of a file that has grown in steps, and its last offset. Every step is read twice: right away, and once the file has grown further."""
    known, out, again = dict(growing.NEW), [], []
    for n, ended in [(c, False) for c in cuts] + [(len(raw), False), (len(raw), True)]:
        there = raw[:n]
        fetch = lambda o, k, b=there: b[o : o + k]
        while True:
            after, _ = growing.advance(fetch, len(there), known, Options("irig"), ended=ended, **more)
            moved = after["at"] != known["at"]
            for b, rows in ((there, out), (raw, again)):
                if after["at"] is not None and moved:
                    read = lambda o, k, b=b: b[o : o + k]
                    start = known["at"] if known["at"] is not None else Framer(read, len(b), Options("irig")).head()
                    carry = Carry.unpacked(known["carry"]) if known["carry"] else Carry()
                    framer = Framer(read, len(b), Options("irig"), start=start, ts_format=after["ts_format"])
                    rows += [r for x in batches(framer, 0, "x", None, known["seq"], carry, after["at"], None) for r in x.to_pylist()]
            known = after
            if not moved or known["done"]:
                break
    assert out == again
    return out, known


@pytest.mark.parametrize("seed", range(12))
def test_steps_do_not_matter(seed):
    r = random.Random(seed)
    raw = R.random_recording(300 + seed, r.choice([30, 400, 2500]), r.choice([0, 0, 3, 20]))
    raw = bytes(r.randrange(256) for _ in range(2 * r.randrange(40))) + raw if seed % 3 == 0 else raw
    if seed % 4 == 1:
        raw = raw[:-1] + b"no record, but text " * 6000 + raw
    whole = Framer(lambda o, n: raw[o : o + n], len(raw), Options("irig"))
    want = [x for b in batches(whole, 0, "x", None, status=None) for x in b.to_pylist()]
    got, end = steps(raw, sorted(r.randrange(len(raw)) for _ in range(r.choice([0, 3, 9]))))
    assert got == want and end["done"]


def test_a_bound_and_marks(monkeypatch):
    monkeypatch.setattr(growing, "BLOCK_BYTES", 1 << 17)
    raw = b"".join(R.record("receive", R.irig(i * 10), rt=i % 30, n=30) for i in range(20_000)) + R.END
    fetch = lambda o, n: raw[o : o + n]
    known, n = dict(growing.NEW), 0
    while not known["done"]:
        known, n = growing.advance(fetch, len(raw), known, Options("irig"), most=300_000)[0], n + 1
    whole, marks = growing.advance(fetch, len(raw), dict(growing.NEW), Options("irig"), stretch=300_000)
    assert 3 < n < 8 and known == whole and whole["seq"] == 20_000
    assert 2 < len(marks) < 6 and all(a["at"] + 300_000 <= b["at"] for a, b in zip(marks, marks[1:]))


def test_what_is_open_waits():
    raw = R.random_recording(1, 20)
    fetch = lambda o, n: raw[o : o + n]
    assert growing.advance(fetch, len(raw), dict(growing.NEW), Options())[0]["at"] is None  # too little to tell the first record
    assert growing.advance(fetch, len(raw), dict(growing.NEW), Options(), ended=True)[0]["done"]
    text = b"text " * SCAN_BYTES
    refused = growing.advance(lambda o, n: text[o : o + n], len(text), dict(growing.NEW), Options())[0]
    assert refused["done"] and refused["state"] == "NoValidRecords"


def test_a_stream_gives_the_rows_and_gaps_of_the_whole(spark, tmp_path):
    raws = [R.random_recording(40 + s, 900, d) for s, d in ((0, 0), (1, 6))]
    paths = [str(tmp_path / f"g{i}.rec") for i in range(2)]
    out, where = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def grow(share, ended=False):
        for p, raw in zip(paths, raws, strict=True):
            with open(p, "ab") as f:
                f.write(raw[f.tell() : int(len(raw) * share)])
        rows = plans.records(growing.read_growing(spark, paths, ended, input_time_format="irig"))
        return rows.select(*COLUMNS).writeStream.format("parquet").option("path", out).option("checkpointLocation", where).start()

    sizes = []
    for share, ended in ((0.5, False), (0.8, False), (1, False), (1, True)):  # a query each, from the checkpoint of the one before
        q = grow(share, ended)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        sizes.append(spark.read.parquet(out).count())
    assert 0 < sizes[0] < sizes[1] < sizes[3]
    want = rows_of(spark, raws, input_time_format="irig")[1].select(*COLUMNS)
    told = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    assert told(spark.read.parquet(out)) == told(want)


def test_one_query_follows_a_file(spark, tmp_path):
    path, raw = str(tmp_path / "late.rec"), R.random_recording(77, 800)
    q = growing.read_growing(spark, [path], input_time_format="irig").writeStream.format("memory").queryName("late").start()
    try:
        q.processAllAvailable()  # the file isn't there yet
        for share in (0.4, 0.8, 1):
            with open(path, "ab") as f:
                f.write(raw[f.tell() : int(len(raw) * share)])
            q.processAllAvailable()
        want = {(r.seq, r.file_offset, r.prev_stamp) for r in rows_of(spark, [raw], input_time_format="irig")[0].filter("kind = 'rec'").collect()}
        assert {(r.seq, r.file_offset, r.prev_stamp) for r in spark.table("late").collect()} == want
    finally:
        q.stop()
