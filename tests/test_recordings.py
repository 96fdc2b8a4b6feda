import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busloom import errors
from busloom.config import Config
from busloom.schema import FIELDS as FIELDS_ALL
from busloom.operators import blocks, collapse, decode, delta, dump, filters, merge, order, pairing
from busloom.plans import recordings as plans
from busloom.sources import inputs, recording, sink
from busloom.sources.framing import Framer, Options, Records, follow
from busloom.sources.recording import read_bytes, read_raw

from . import recordings as R

FIELDS = ("file_offset", "message_type", "time_us", "rt", "error_word", "status_word", "status_word_2", "command_word_2", "delta_us", "message_format")


def put(folder, name, raw):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(raw)
    return path


def rows_of(spark, raws, **options):
    frame = spark.createDataFrame([(i, f"f{i}", bytearray(r)) for i, r in enumerate(raws)], "file_index int, name string, content binary")
    raw = read_bytes(frame, **options)
    recs = delta.with_delta(pairing.pair(decode.decode(raw)))
    return raw, recs


#: What the source tells of a record from those before it.
TOLD = ("parent", "stamp", "prev_stamp", "high", "back")


def by_file(recs):
    got = {}
    for r in recs.orderBy("file_index", "seq").collect():
        got.setdefault(r.file_index, []).append(([r[f] for f in FIELDS], list(r.data_words)))
    return got


def model_rows(raw):
    return [([row[f] for f in FIELDS], row["data_words"]) for row in R.read_irig(raw).rows]


@pytest.mark.parametrize("told", [True, False])
@pytest.mark.parametrize("damage", [0, 1, 6])
def test_against_model(spark, damage, told):
    """With what the source tells of earlier records, and with windows in its place."""
    raws = [R.random_recording(100 * damage + s, 80, damage) for s in range(40)]
    raw, recs = rows_of(spark, raws, input_time_format="irig")
    if not told:
        recs = delta.with_delta(pairing.pair(decode.decode(raw.drop(*TOLD))))
    got = by_file(recs)
    for i, r in enumerate(raws):
        assert got.get(i, []) == model_rows(r), i


@pytest.mark.parametrize("damage,piece,strict", [(0, 600, False), (2, 600, False), (12, 600, False), (12, 5000, False), (0, 600, True), (1, 5000, True), (2, 600, True)])
def test_pieces_do_not_matter(spark, tmp_path, monkeypatch, damage, piece, strict):
    """A file that is read in pieces gives the rows of the whole, sequence numbers, facts and status included."""
    raws = [R.random_recording(1000 + 10 * damage + s, 400, damage) for s in range(4)] + [b"no recording " * 900, R.END]
    paths = [put(tmp_path, f"p{i}", r) for i, r in enumerate(raws)]
    monkeypatch.setattr(recording, "LEAST_PIECE", piece)
    monkeypatch.setattr(recording, "MOST_PIECE", piece)
    found = recording.surveyed(spark, paths, input_time_format="irig", strict=strict)
    assert strict and damage or max(len(f.pieces) for f in found) > 3
    cut = recording.read_pieces(spark, [p for f in found for p in f.pieces], input_time_format="irig", strict=strict)
    whole, _ = rows_of(spark, raws, input_time_format="irig", strict=strict)
    rows = lambda df: [tuple(r) for r in df.filter("kind <> 'status'").drop("source_path", "mux").orderBy("file_index", "seq").collect()]
    assert rows(cut) == rows(whole)
    ends = lambda df: {r.file_index: json.loads(r.detail) for r in df.filter("kind = 'status'").collect()}
    assert ends(cut) == ends(whole)
    back = whole.filter("back").groupBy("file_index").agg(F.count("*").alias("n"), F.min("seq").alias("first")).collect()
    assert {r.file_index: (r.n, r.first) for r in back} == {i: (f.back, f.first_back) for i, f in enumerate(found) if f.back}


@pytest.mark.parametrize("strict", [False, True])
def test_wrong_guesses_everywhere_take_one_more_job(spark, tmp_path, monkeypatch, strict):
    """Data that look like records stand at every border, so that every guess is wrong."""
    piece = 4000
    inner = R.record("receive", R.irig(0), rt=1, n=3)
    words = [int.from_bytes(inner[i : i + 2], "little") for i in range(0, len(inner), 2)]
    out, t = b"", 0
    while len(out) < 20 * piece:
        t += 1
        plain = R.record("receive", R.irig(t * 1000), rt=t % 30, n=30)
        trap = R.record("receive", R.irig(t * 1000), rt=t % 30, n=30, data=(words * 4)[:30])
        out += trap if len(out) % piece > piece - 2 * len(trap) or len(out) % piece < 400 else plain
    path = put(tmp_path, "trap", out)
    jobs, real = [], recording._job
    monkeypatch.setattr(recording, "_job", lambda spark, tasks, framing: jobs.append(len(tasks)) or real(spark, tasks, framing))
    monkeypatch.setattr(recording, "LEAST_PIECE", piece)
    monkeypatch.setattr(recording, "MOST_PIECE", piece)
    monkeypatch.setattr(recording, "DEPTH", 1)  # what looks like one record is taken for one, right at the border
    monkeypatch.setattr(recording, "RUN_UP", 0)
    found = recording.surveyed(spark, [path], input_time_format="irig", strict=strict, lookahead_records=1)
    assert len(jobs) == 2 and jobs[0] >= 20 and jobs[1] > 10 and len(found[0].pieces) > 15
    whole, _ = rows_of(spark, [out], input_time_format="irig", strict=strict)
    cut = recording.read_pieces(spark, found[0].pieces, input_time_format="irig", strict=strict)
    rows = lambda df: [tuple(r) for r in df.filter("kind <> 'status'").drop("source_path", "mux").orderBy("seq").collect()]
    assert rows(cut) == rows(whole)


def test_what_the_source_tells(spark):
    """Stamps, gaps and steps back as windows over the decoded records give them."""
    raws = [R.random_recording(70 + s, 300, 4) for s in range(6)]
    raw, _ = rows_of(spark, raws, input_time_format="irig")
    decoded = decode.decode(raw)
    told = pairing.pair(decoded)
    slow = pairing.pair(decode.decode(raw.drop(*TOLD)))
    key = ("file_index", "seq")
    assert {tuple(r) for r in told.select(*key, "merge_us").collect()} == {tuple(r) for r in merge.merged(slow).select(*key, "merge_us").collect()}
    steps = told.filter("back").groupBy("file_index").agg(F.count("*").alias("steps"), F.min("seq").alias("first_seq"))
    assert {tuple(r) for r in steps.collect()} == {tuple(r) for r in merge.backward_files(slow).collect()}
    for f in (filters.Filters(exclude_rts=tuple(range(9))), filters.Filters(include_types=(2, 32), exclude_buses=(1,)), filters.Filters(exclude_types=(32,), include_subaddresses=tuple(range(12)))):
        assert {tuple(r) for r in filters.apply_filters(told, f).select(*key).collect()} == {tuple(r) for r in filters.apply_filters(slow, f).select(*key).collect()}
    for window, cap in ((0, None), (500, None), (300, 3)):
        both = [collapse.collapse(merge.merged(x), window, cap, cap is not None and window == 0).select(*key) for x in (told, slow)]
        assert {tuple(r) for r in both[0].collect()} == {tuple(r) for r in both[1].collect()}


def test_chains():
    """Following all lanes at once gives what following one record after the other gives."""
    r = np.random.default_rng(5)
    for case in range(60):
        n = int(r.integers(1, 60_000))
        step = r.integers(1, 64, n).astype(np.int32)
        ok = r.random(n) < (1.0 if case % 3 == 0 else 0.9999 if case % 3 == 1 else 0.97)
        at, stop = int(r.integers(0, n)), int(r.integers(0, n + 1))
        want, i = [], at
        while i < min(stop, n) and ok[i]:
            want.append(i)
            i += int(step[i])
        got, here = follow(ok, step, at, stop)
        assert got.tolist() == want and here == i, case


def test_blocks_do_not_matter():
    raw = R.random_recording(5, 6000, 12)
    both = []
    for block in (1, 1 << 22):
        f = Framer(lambda o, n: raw[o : o + n], len(raw), Options("irig"), block)
        both.append(([o for x in f if isinstance(x, Records) for o in x.offsets.tolist()], f.status.state, f.status.sync_losses))
    assert both[0] == both[1]
    assert len(both[0][0]) > 4000


def test_file_ends():
    def state(raw, **o):
        f = Framer(lambda a, n: raw[a : a + n], len(raw), Options(**o))
        n = sum(len(x.offsets) for x in f if isinstance(x, Records))
        return f.status.state, n

    good = [R.record("receive", R.irig(1000 * i), n=3 + i) for i in range(4)]
    assert state(b"".join(good) + R.END) == ("complete", 4)
    assert state(b"".join(good)) == ("complete", 4)
    assert state(b"") == ("EmptyFile", 0)
    assert state(R.END) == ("empty-recording", 0)
    assert state(b"hello, this is a text file and not a recording at all ") == ("NoValidRecords", 0)
    assert state(good[1] * 8) == ("HomogeneousPayload", 0)
    assert state(b"".join(good)[:-4]) == ("truncated-tail", 3)
    assert state(b"".join(good)[:-4], strict=True)[0] == "RecordTruncated"
    assert state(good[0][:10], strict=True)[0] == "FirstRecordTruncated"
    assert state(b"\xff\xff" * 5 + b"".join(good)) == ("complete", 4)
    assert state(b"".join(good) + b"\xff\x7f" * 40_000 + b"".join(good))[0] == "UnrecoverableSyncLoss"
    std = [R.record("receive", R.standard(1000 * i), n=3 + i) for i in range(6)]
    f = Framer(lambda a, n: b"".join(std)[a : a + n], len(b"".join(std)), Options())
    assert sum(len(x.offsets) for x in f) == 6 and f.status.ts_format == "standard"
    assert state(b"".join(std), input_time_format="irig", strict=True)[0] in ("TimestampFormatMismatch", "NoValidRecords", "FirstRecordTruncated")


def test_source_and_csv(spark, tmp_path):
    a = put(tmp_path, "x.y.z.w.CH1.rec", R.random_recording(1, 50, start=10_000_000))
    b = put(tmp_path, "b.rec", R.random_recording(2, 50, start=10_001_000))
    raw = read_raw(spark, [a, b])
    assert raw.filter("kind = 'status'").count() == 2
    assert {r.mux for r in raw.filter("file_index = 0").select("mux").distinct().collect()} == {"CH1"}
    out = str(tmp_path / "out.csv")
    done = plans.decode_to_csv(spark, [a], out)
    lines = open(out).read().split("\n")
    assert lines[0].count(",") == 45 and lines[0].startswith("TIME_STAMP,RT,MSG,WD01") and len(lines) == done.files[0].rows + 2
    assert done.files[0].rows == plans.count(spark, a) == len(R.read_irig(open(a, "rb").read()).rows)
    with pytest.raises(errors.OutputExists):
        plans.decode_to_csv(spark, [a], out, Config(no_clobber=True))
    split = plans.decode_to_csv(spark, [a, b], str(tmp_path / "m.csv"), Config(error_mode="separate"))
    assert [os.path.basename(f.path) for f in split.files] == ["m.csv", "m_errors.csv"]
    assert sum(f.rows for f in split.files) == plans.count(spark, a) + plans.count(spark, b)
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".tmp")]
    with pytest.raises(errors.CalendarError):
        plans.decode_to_csv(spark, [a], str(tmp_path / "n.csv"), Config(output_time_format="iso"))
    plans.decode_to_csv(spark, [a], str(tmp_path / "i.csv"), Config(output_time_format="iso", year=2024))
    assert open(tmp_path / "i.csv").read().split("\n")[1].startswith("2024-01-10T")
    with pytest.raises(errors.FileMissing):
        read_raw(spark, [str(tmp_path / "none")])
    t = plans.table(spark, [a], ["rt", "data_words"], padded=True).collect()
    assert all(len(r.data_words) == 32 for r in t)
    assert plans.exit_code(errors.ConfigError()) == 5


def test_strict(spark, tmp_path):
    good = [R.record("receive", R.irig(1000 * i), n=3 + i) for i in range(4)]
    bad = R.record("receive", R.irig(9000), n=4, transmit=1)
    p = put(tmp_path, "a", b"".join(good) + bad + good[0])
    with pytest.raises(errors.PayloadError):
        plans.decode_to_csv(spark, [p], str(tmp_path / "o.csv"), Config(strict=True))
    assert not os.path.exists(tmp_path / "o.csv")
    assert plans.count(spark, p) == 5
    assert plans.records(plans.raw(spark, [p], Config(strict=True)), Config(strict=True)).count() == 4


def _merge_model(files):
    """Takes the earliest of the files' next records, again and again."""
    at, out = [0] * len(files), []
    while any(i < len(f) for i, f in zip(at, files, strict=True)):
        k = min((f[i][0], n) for n, (i, f) in enumerate(zip(at, files, strict=True)) if i < len(f))[1]
        out.append((k, at[k], *files[k][at[k]]))
        at[k] += 1
    return out


def _frame(spark, cases):
    """Rows (case, file_index, seq, time_us, rt...) as records."""
    rows = []
    for c, files in enumerate(cases):
        for f, recs in enumerate(files):
            for s, (us, rt, err) in enumerate(recs):
                spur = rt is None
                rows.append((c, f, s, us, rt, 1 if rt is not None else None, 0 if rt is not None else None, bool(err), 32 if spur else 2, 0x2000 if spur and err else None, 1, [rt or 0], None, None, None, rt))
    return spark.createDataFrame(rows, "case int, file_index int, seq long, time_us long, rt int, subaddress int, direction int, error boolean, message_type int, error_word int, bus int, data_words array<int>, command_word_2 int, status_word int, status_word_2 int, command_word int").withColumn("type_word", F.lit(1)).withColumn("ts_format", F.lit("irig")).withColumn("freerun", F.lit(False))


def test_merge_and_collapse(spark):
    r = random.Random(3)
    for case in range(8):
        sorted_files = case % 2 == 0
        files = []
        for _ in range(r.randrange(1, 4)):
            times = [r.randrange(12) for _ in range(r.randrange(1, 12))]
            files.append([(t, r.randrange(3), 0) for t in (sorted(times) if sorted_files else times)])
        df = merge.merged(_frame(spark, [files]).drop("case"))
        got = [(x.file_index, x.seq) for x in merge.in_merge_order(df).collect()]
        want = _merge_model(files)
        assert got == [(a, b) for a, b, *_ in want]
        for window in (0, 2):
            rule = collapse.Survivors(window)
            keep = [(f, s) for f, s, us, rt, _ in want if not rule.duplicate(us, f, str(rt))]
            out = collapse.collapse(df, window, None, sorted_files)
            assert sorted((x.file_index, x.seq) for x in out.collect()) == sorted(keep), (case, window)
        rule = collapse.Survivors(3, 2)
        keep = [(f, s) for f, s, us, rt, _ in want if not rule.duplicate(us, f, str(rt))]
        assert sorted((x.file_index, x.seq) for x in collapse.collapse(df, 3, 2).collect()) == sorted(keep)


def test_merge_refuses(spark):
    df = _frame(spark, [[[(1, 1, 0)], [(2, 1, 0)]]]).withColumn("freerun", F.col("file_index") == 1)
    with pytest.raises(errors.MergeIncompatible):
        merge.check_mergeable(df)
    back = _frame(spark, [[[(5, 1, 0), (1, 1, 0)]]])
    assert not merge.check_monotone(back, False)
    with pytest.raises(errors.BackwardStep):
        merge.check_monotone(back, True)


def _order_model(rows, cap):
    """rows: (time, key or None) in arrival order; returns positions in canonical order."""
    runs = []
    for i, (t, _) in enumerate(rows):
        if runs and rows[runs[-1][-1]][0] == t:
            runs[-1].append(i)
        else:
            runs.append([i])
    out = []
    for n, run in enumerate(runs):
        nxt = rows[runs[n + 1][0]] if n + 1 < len(runs) else None
        for lo in range(0, len(run), cap):
            seg = run[lo : lo + cap]
            if len(seg) == cap:
                out += seg
                continue
            lead, chunks = [], []
            for i in seg:
                if rows[i][1] is not None:
                    chunks.append([i])
                elif chunks:
                    chunks[-1].append(i)
                else:
                    lead.append(i)
            done = sorted(chunks, key=lambda c: rows[c[0]][1])
            if nxt is not None and nxt[1] is None and chunks and lo + cap > len(run) and rows[done[-1][0]][1] != rows[chunks[-1][0]][1]:
                out += seg
                continue
            out += lead + [i for c in done for i in c]
    return out


@pytest.mark.parametrize("monotone", [True, False])
def test_order(spark, monotone):
    r = random.Random(11 + monotone)
    cases = []
    for _ in range(150):
        times = [r.randrange(5) for _ in range(r.randrange(1, 14))]
        cases.append([[(400_000 * t, r.choice([None, 1, 2, 3]), 0) for t in (sorted(times) if monotone else times)]])
    df = _frame(spark, cases)
    for cap in (1, 2, 3, 100):
        o = order.order_rows(df, cap, ("seq",), ("case",), monotone)
        got = {}
        for x in o.orderBy("case", *order.sort_columns()).select("case", "seq").collect():
            got.setdefault(x.case, []).append(x.seq)
        for c, ((rows,),) in enumerate(zip(cases, strict=True)):
            want = _order_model([(t, None if k is None else k) for t, k, _ in rows], cap)
            assert got[c] == want, (c, cap, rows)


def test_filters(spark):
    recs = [(1, 3, 1), (1, None, 1), (2, 4, 1), (3, None, 1), (4, None, 1), (5, 3, 0), (6, None, 0)]
    df = _frame(spark, [[recs]])
    seqs = lambda f: [x.seq for x in filters.apply_filters(df, f).orderBy("seq").collect()]
    assert seqs(filters.Filters()) == list(range(7))
    assert seqs(filters.Filters(exclude_rts=(3,))) == [2, 3, 4, 6]
    assert seqs(filters.Filters(include_rts=(4,))) == [2, 3]
    assert seqs(filters.Filters(include_types=(2,))) == [0, 2, 5]
    assert seqs(filters.Filters(exclude_types=(32,))) == [0, 2, 5]
    assert seqs(filters.Filters(include_buses=(0,))) == []
    assert filters.parse_type(" rt_to_bc ") == filters.parse_type("0x04") == 4
    for bad in ("4", "0x03", "x"):
        with pytest.raises(errors.ConfigError):
            filters.parse_type(bad)


def test_stream(spark, tmp_path):
    from busloom.streaming.gaps import stream_delta

    files = [R.random_recording(s, 40, start=5_000_000) for s in (1, 2)]
    _, recs = rows_of(spark, files, input_time_format="irig")
    want = {(r.file_index, r.seq): r.delta_us for r in recs.filter("rt is not null").collect()}
    src = str(tmp_path / "in")
    recs.select("file_index", "rt", "subaddress", "direction", "seq", "time_us").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = stream_delta(stream).writeStream.outputMode("append").format("memory").queryName("gaps").start()
    try:
        q.processAllAvailable()
        got = {(r.file_index, r.seq): r.delta_us for r in spark.table("gaps").collect()}
    finally:
        q.stop()
    assert got == want


def test_inputs(tmp_path):
    for n in ("a1.rec", "a2.rec", "a[3].rec", "b.rec"):
        put(tmp_path, n, b"x")
    assert [os.path.basename(p) for p in inputs.expand_glob(str(tmp_path / "a?.rec"))] == ["a1.rec", "a2.rec"]
    assert [os.path.basename(p) for p in inputs.expand_glob(str(tmp_path / "a[*].rec"))] == ["a[3].rec"]
    with pytest.raises(errors.UsageError):
        inputs.expand_glob(str(tmp_path) + "*/a.rec")
    m = put(tmp_path, "list", b"# c\r\n  a b \r\n\n\tz\t\n")
    assert inputs.read_manifest(m) == ["a b", "z"]
    with pytest.raises(errors.UsageError):
        inputs.resolve(["a"], manifest=m)
    assert inputs.mux_of("/x/a.b.c", index=-1) == "c" and inputs.mux_of("a.b.c", index=5) is None and inputs.mux_of("a. \t.c", index=1) is None
    assert inputs.mux_of("a", value="V") == "V"


def test_config(tmp_path):
    from busloom import config

    c = config.parse('[decode]\nstrict = true\n[filter]\nexclude_types = ["RT_TO_BC", "0x20"]\nexclude_rts = [3]\n[output]\nutc_offset = "+01:00"\n[odd]\nx = 1\n')
    assert c.strict and c.filters.exclude_types == (4, 32) and c.utc_offset == 60
    assert c.over(exclude_rts=(3, 5), strict=False).filters.exclude_rts == (3, 5)
    for bad in ("[decode]\ndetect_records = 0\n", "[decode]\nstrict = 1\n", "[filter]\nexclude_rts = [32]\n", "x", "[output]\nyear = 0\n"):
        with pytest.raises(errors.ConfigError):
            config.parse(bad)


def test_dump(tmp_path):
    p = put(tmp_path, "d", R.record("receive", R.irig(1000)) + R.record("spurious", R.irig(2000)) + R.END)
    lines = list(dump.hex_lines(p, 0, 20))
    assert len(lines) == 2 and lines[1].startswith("00000010") and list(dump.hex_lines(p, 10_000, 5)) == []
    text = list(dump.record_lines(p))
    assert "BC_TO_RT" in text[0] and "terminator" in text[-1] and len(list(dump.record_lines(p, records=1))) < len(text)


def test_command_line(spark, tmp_path):
    import io

    from busloom import cli

    a = put(tmp_path, "a.rec", R.random_recording(1, 50, start=10_000_000))
    put(tmp_path, "b.rec", R.random_recording(2, 50, start=10_001_000))
    out = io.StringIO()
    assert cli.run(["count", a], spark, out) == 0 and int(out.getvalue()) == plans.count(spark, a)
    o = str(tmp_path / "o.csv")
    assert cli.run(["decode", "--glob", str(tmp_path / "?.rec"), "-o", o, "--exclude-types", "rt_to_bc,0x20", "--delta-scope", "global", "--collapse-duplicates"], spark) == 0
    assert ",SPURIOUS," not in open(o).read() and len(open(o).read().split("\n")) > 10
    assert cli.run(["dump", a, "--records", "2"], out=out) == 0
    assert cli.run(["decode"], spark) == errors.USAGE
    raw, piped = io.BytesIO(), io.BytesIO()
    assert cli.run(["decode", a, "--no-mux"], spark, raw) == 0
    assert cli.run(["decode", "-", "--no-mux", "--separate-errors", "--log-level", "ERROR"], spark, piped, io.BytesIO(open(a, "rb").read())) == 0
    assert raw.getvalue() == piped.getvalue() and raw.getvalue().startswith(b"TIME_STAMP,")
    hexed = io.StringIO()
    assert cli.run(["dump", a, "--raw", "--length", "32", "--config", put(tmp_path, "c.toml", b"")], out=hexed) == 0 and len(hexed.getvalue().splitlines()) == 2
    assert cli.run(["decode", a, "-o", o, "--year", "0"], spark) == errors.CONFIG
    assert cli.run(["count", str(tmp_path / "none")], spark) == errors.RUNTIME
    assert cli.run(["count", put(tmp_path, "t", b"no recording " * 9)], spark) == errors.NO_RECORDS


def test_partial_merge(spark, tmp_path):
    a = put(tmp_path, "a.rec", R.random_recording(1, 50, start=10_000_000))
    bad = put(tmp_path, "bad.rec", b"no recording " * 9)
    o = str(tmp_path / "o.csv")
    with pytest.raises(errors.NoValidRecords):
        plans.decode_to_csv(spark, [a, bad], o)
    done = plans.decode_to_csv(spark, [a, bad], o, Config(allow_partial=True))
    assert done.left_out == [bad] and done.exit_code == errors.SYNC_LOSS and [f.path for f in done.files] == [o + ".partial"] and not os.path.exists(o)
    lost = put(tmp_path, "lost.rec", R.random_recording(1, 20)[:-2] + b"\xff\x7f" * 40_000)
    with pytest.raises(errors.UnrecoverableSyncLoss):
        plans.decode_to_csv(spark, [lost], o)
    assert plans.decode_to_csv(spark, [lost], o, Config(allow_partial=True)).exit_code == errors.SYNC_LOSS


def test_counter_times(spark, tmp_path):
    """A counter that wraps isn't in order: equal times apart are runs of their own."""
    ticks = [10, 10, 20, 10, 10]
    rts = [5, 3, 1, 5, 2]
    raw = b"".join(R.record("receive", R.standard(t), rt=rt, n=4) for t, rt in zip(ticks, rts, strict=True))
    p = put(tmp_path, "s.rec", raw + R.END)
    df = plans.table(spark, [p], ["rt", "ticks", "time_us", "timestamp", "delta"], Config(input_time_format="standard"))
    assert [(r.rt, r.ticks) for r in df.collect()] == [(3, 10), (5, 10), (1, 20), (2, 10), (5, 10)]
    assert {(r.time_us, r.delta) for r in df.collect()} == {(None, None)} and df.first().timestamp == "0x0000000A"
    rated = plans.table(spark, [p], ["rt", "time_us", "delta"], Config(input_time_format="standard", standard_tick_rate_hz=2e6)).collect()
    assert [r.time_us for r in rated] == [5, 5, 10, 5, 5] and [r.delta for r in rated if r.rt == 5] == [0.0, 0.0]
    with pytest.raises(errors.MergeIncompatible):
        plans.decode_to_csv(spark, [p, p], str(tmp_path / "o.csv"), Config(input_time_format="standard"))


@pytest.mark.parametrize("span", [60_000_000, 3])
def test_global_gaps(spark, monkeypatch, span):
    """Also with blocks of a few microseconds, whose edges then cut gaps."""
    monkeypatch.setattr(blocks, "SPAN_US", span)
    r = random.Random(span)
    for _ in range(3):
        files = [[(t, r.choice([None, 1, 2]), 0) for t in [r.randrange(20) for _ in range(15)]] for _ in range(2)]
        last, want = {}, {}
        for f, s, us, rt, _ in _merge_model(files):
            want[f, s] = None if rt is None else 0 if rt not in last else us - last[rt] if us >= last[rt] else None
            last[rt] = us
        df = delta.with_delta(merge.merged(_frame(spark, [files]).drop("case")), "global", merge.ORDER)
        assert {(x.file_index, x.seq): x.delta_us for x in df.collect()} == want


def csv_of(spark, path, paths, config=None):
    plans.decode_to_csv(spark, paths, path, config or Config())
    return open(path).read().split("\n")[1:-1]


@pytest.mark.parametrize("cap", [65_536, 2])
def test_lines_come_in_canonical_order(spark, tmp_path, monkeypatch, cap):
    """Whatever the pieces: the lines are those of the table in canonical order, also where a run ends a piece."""
    monkeypatch.setattr(recording, "LEAST_PIECE", 900)
    monkeypatch.setattr(recording, "MOST_PIECE", 900)
    r = random.Random(cap)
    files = []
    for k in range(3):
        us, out = 5_000_000, []
        for _ in range(250):
            us += r.choice([0, 0, 0, 40])
            kind = r.choice(["receive", "transmit", "receive", "spurious"])
            out.append(R.record(kind, R.irig(us), r.randrange(1, 9), r.randrange(1, 5), r.randrange(1, 6)))
        files.append(put(tmp_path, f"t{k}.rec", b"".join(out) + R.END))
    out = str(tmp_path / "o.csv")
    for paths in (files[:1], files):
        for f in (filters.Filters(), filters.Filters(exclude_rts=(1, 2, 3)), filters.Filters(exclude_types=(32,))):
            c = Config(max_sort_group=cap, filters=f)
            df, by = plans.analysis(spark, paths, c).ordered(cap)
            want = [",".join(x) for x in sink.csv_rows(df.orderBy(*by)).collect()]
            assert csv_of(spark, out, paths, c) == want
            split = plans.decode_to_csv(spark, paths, out, c.over(error_mode="separate"))
            bad = [w for w in want if ",SPURIOUS," in w]
            assert open(out).read().split("\n")[1:-1] == [w for w in want if ",SPURIOUS," not in w]
            assert (len(split.files) == 2) == bool(bad) and (not bad or open(split.files[1].path).read().split("\n")[1:-1] == bad)


def test_lines_of_files_out_of_order(spark, tmp_path):
    paths = [put(tmp_path, f"z{s}.rec", R.random_recording(300 + s, 200, 2)) for s in range(2)]
    for own in (paths[:1], paths):
        for f in (filters.Filters(), filters.Filters(exclude_buses=(1,))):
            c = Config(input_time_format="irig", filters=f)
            df, by = plans.analysis(spark, own, c).ordered(c.max_sort_group)
            assert csv_of(spark, str(tmp_path / "o.csv"), own, c) == [",".join(x) for x in sink.csv_rows(df.orderBy(*by)).collect()]


def test_a_folder_of_files(spark, tmp_path):
    paths = [put(tmp_path, f"g{s}.rec", R.random_recording(40 + s, 120, start=10_000_000)) for s in range(2)]
    c = Config(input_time_format="irig")
    done = plans.decode_to_folder(spark, paths, str(tmp_path / "many"), c)
    parts = sorted(p for p in os.listdir(tmp_path / "many") if p.startswith("part-"))
    lines = [x for p in parts for x in open(tmp_path / "many" / p).read().split("\n")[1:-1]]
    assert lines == csv_of(spark, str(tmp_path / "o.csv"), paths, c) and done.counters["kept"] == len(lines)


def test_an_input_is_never_overwritten(spark, tmp_path):
    """By another spelling of its path, a link to it, or a name that the run may take later."""
    raw = R.random_recording(1, 50)
    a = put(tmp_path, "a.rec", raw)
    os.symlink(a, tmp_path / "link.csv")
    os.link(a, tmp_path / "hard.csv")
    odd = put(tmp_path, "x.csv.partial", raw)
    errs = put(tmp_path, "y_errors.csv", raw)
    for inputs_, out in (([a], f"{tmp_path}/./a.rec"), ([a], str(tmp_path / "link.csv")), ([a], str(tmp_path / "hard.csv")), ([str(tmp_path / "link.csv")], a), ([odd], str(tmp_path / "x.csv"))):
        with pytest.raises(errors.UsageError):
            plans.decode_to_csv(spark, inputs_, out)
    with pytest.raises(errors.UsageError):
        plans.decode_to_csv(spark, [errs], str(tmp_path / "y.csv"), Config(error_mode="separate"))
    assert all(open(p, "rb").read() == raw for p in (a, odd, errs))


def test_counters_and_warnings(spark, tmp_path):
    """What was left out, moved or doubtful is counted, and told once."""
    good = [R.record("receive", R.irig(1000 * i), rt=1 + i % 3, n=3 + i % 5) for i in range(1, 9)]
    odd = [R.record("receive", R.irig(20_000), rt=4, n=2, status=7 << 11), R.record("receive", R.irig(21_000), rt=5, n=4, transmit=1), R.record("receive", R.irig(22_000), rt=1, n=2, error=0x0999), R.record("receive", R.irig(500), rt=1, n=2)]
    a = put(tmp_path, "a.rec", b"".join(good + odd) + R.END)
    b = put(tmp_path, "b.rec", b"".join(good) + R.END)
    c = Config(collapse_duplicates=True, filters=filters.Filters(exclude_rts=(3,)))
    done = plans.decode_to_csv(spark, [a, b], str(tmp_path / "o.csv"), c)
    told = done.counters
    assert (told["rejected"], told["status_mismatch"], told["unknown_codes"], told["collapsed"]) == (1, 1, 1, 8)
    assert told["filtered"] == 3 and told["kept"] == done.files[0].rows == 8 and told["backward_gaps"] == 1
    assert any("back in time" in w for w in done.warnings) and any("skipped" in w for w in done.warnings)
    ties = put(tmp_path, "t.rec", b"".join(R.record("receive", R.irig(1000), rt=9 - i, n=2) for i in range(5)) + R.END)
    capped = plans.decode_to_csv(spark, [ties], str(tmp_path / "t.csv"), Config(max_sort_group=2))
    assert capped.counters["capped_runs"] == 1
    wrap = put(tmp_path, "w.rec", b"".join(R.record("receive", R.irig(1000, d), n=2 + d % 7) for d in (364, 365, 1, 2)) + R.END)
    dated = plans.decode_to_csv(spark, [wrap], str(tmp_path / "w.csv"), Config(output_time_format="iso", year=2023))
    assert dated.counters["wrapped_days"] and any("year" in w for w in dated.warnings)


def test_the_cap_holds_for_files_in_order(spark):
    """A cap on survivors is kept where it can bind, though files are in order of time."""
    files = [[(t // 3, t % 7, 0) for t in range(40)], [(t // 3 + 5, t % 7, 0) for t in range(40)]]
    df = merge.merged(_frame(spark, [files]).drop("case"))
    rule = collapse.Survivors(6, 4)
    keep = [(f, s) for f, s, us, rt, _ in _merge_model(files) if not rule.duplicate(us, f, str(rt))]
    assert rule.dropped_early and collapse.cap_binds(df, 6, 4) and not collapse.cap_binds(df, 6, 4096)
    got = collapse.marked(df, 6, 4, True)
    assert sorted((x.file_index, x.seq) for x in got.filter("not collapsed").collect()) == sorted(keep)
    assert got.filter("capped").count() == rule.dropped_early
    assert collapse.collapse(df, 6, 4, True).count() != collapse.collapse(df, 6, 4096, True).count()


def test_survivors_against_a_list():
    """The rule with heaps and a table, against one that looks through all that is kept."""
    for seed in range(40):
        r = random.Random(seed)
        window, cap = r.choice([0, 3, 10]), r.choice([None, 1, 3, 8])
        rule, kept = collapse.Survivors(window, cap), []
        for _ in range(200):
            us, f, d = r.randrange(60), r.randrange(3), r.randrange(4)
            kept = [k for k in kept if abs(us - k[0]) <= window]
            want = any(k[2] == d and k[1] != f for k in kept)
            if not want:
                kept.append((us, f, d))
                if cap is not None and len(kept) > cap:
                    kept.pop(0)
            assert rule.duplicate(us, f, d) == want


def test_few_words_leave_the_source(spark, tmp_path):
    """Fields that need only the head of a record come out the same without the rest of its words."""
    paths = [put(tmp_path, f"h{s}.rec", R.random_recording(900 + s, 150, 3 * s, start=10_000_000)) for s in range(2)]
    fields = [f for f in FIELDS_ALL if f in plans.HEAD_FIELDS]
    assert {"rt", "delta", "message_format"} <= set(fields) and "data_words" not in fields
    for own in (paths[:1], paths):
        c = Config(input_time_format="irig", filters=filters.Filters(exclude_rts=(1, 2, 3), exclude_types=(8,)))
        few = plans.table(spark, own, fields, c).collect()
        assert few == plans.table(spark, own, [*fields, "data_words"], c).select(*fields).collect()
    whole = len(R.read_irig(open(paths[1], "rb").read()).rows)
    c = Config(input_time_format="irig")
    assert plans.count(spark, paths[1], c) == whole == plans.records(plans.raw(spark, [paths[1]], c), c).count()
    out = Config(input_time_format="irig", filters=filters.Filters(exclude_rts=(1, 2, 3)))
    assert plans.count(spark, paths[1], out) == plans.counted(plans.records(plans.raw(spark, [paths[1]], out), out), out).first().n < whole


def test_a_stream_out_of_order_stops(spark, tmp_path):
    from busloom.streaming.gaps import _observe

    class State:
        exists, get = True, (500, 7)

    with pytest.raises(ValueError):
        list(_observe((0, 1, 2, 0), iter([pd.DataFrame({"seq": [7, 9], "time_us": [600, 700]})]), State()))


def test_parts_are_placed_by_tasks(spark, tmp_path):
    """Files of any size, empty ones too, stand in their order in the one file, with the bytes between them."""
    from busloom.schema import CSV_COLUMNS
    from busloom.sources import sink

    parts, want = [], (",".join(CSV_COLUMNS) + "\n").encode()
    for i, n in enumerate((0, 5, 300_000, 1, 0, 70_000)):
        data, more = bytes([65 + i]) * n, b"" if i % 2 else b"between%d\n" % i
        p = tmp_path / f"part{i}"
        p.write_bytes(data)
        parts.append((str(p), more))
        want += data + more
    parts.append((None, b"end\n"))
    assert sink.CsvFile(str(tmp_path / "o.csv")).place(spark, parts, 9).rows == 9
    assert (tmp_path / "o.csv").read_bytes() == want + b"end\n"
    assert (tmp_path / "part2").exists()  # a task that is lost can run again
    parts[2] = (str(tmp_path / "gone"), b"")
    with pytest.raises(OSError):
        sink.CsvFile(str(tmp_path / "p.csv")).place(spark, parts, 9)
    assert not [p for p in tmp_path.iterdir() if "p.csv" in p.name]


def test_standard_input_stands_where_tasks_see_it(spark, tmp_path, monkeypatch):
    from io import BytesIO

    from busloom import cli, shared

    seen = []
    monkeypatch.setattr(cli, "_received", lambda stream, folder, real=cli._received: seen.append(folder) or real(stream, folder))
    stream = BytesIO(b"".join(R.record("receive", R.irig(1000 * i), rt=1 + i % 3, n=3) for i in range(1, 9)) + R.END)
    stream.isatty = lambda: False
    assert cli.run(["decode", "-", "-o", str(tmp_path / "o.csv")], spark, stdin=stream) == 0
    assert len((tmp_path / "o.csv").read_text().splitlines()) == 9
    assert seen[0].startswith(shared.shared_path(spark)) and not os.path.exists(seen[0])
    monkeypatch.setattr(shared, "shared_dir", lambda spark: "hdfs://host/x")
    with pytest.raises(shared.UsageError):
        shared.shared_path(spark)


def test_each_key_that_steps_back_is_told_once(spark, tmp_path):
    steps = [(1, 0), (2, 500), (1, 100), (2, 400), (1, 50), (3, 0), (2, 390), (4, 900), (4, 901)]
    a = put(tmp_path, "a.rec", b"".join(R.record("receive", R.irig(us), rt=rt, n=2) for rt, us in steps) + R.END)
    done = plans.decode_to_csv(spark, [a], str(tmp_path / "o.csv"), Config(filters=filters.Filters(exclude_rts=(1,))))
    told = [w for w in done.warnings if "key" in w]
    assert len(told) == 2 and done.counters["backward_gaps"] == 3
    assert "key 1:2[R]: 1 step(s)" in told[0] and "key 2:2[R]: 2 step(s)" in told[1]


def test_version_and_the_option_that_became_two(capsys):
    from busloom import __version__, cli

    assert cli.run(["--version"]) == 0 and __version__ in capsys.readouterr().out
    for given in (["--time-format", "iso"], ["--time-format=irig"]):
        assert cli.run(["decode", "x.rec", *given]) == 4
        said = capsys.readouterr().err
        assert "--input-time-format" in said and "--output-time-format" in said
