import os

import pytest
from pyspark.sql import functions as F

from busloom.errors import UsageError
from busloom.operators.filters import Filters
from busloom.plans import recordings as plans
from busloom.sources import index, recording
from busloom.sources.framing import Options
from busloom.sources.selection import Selection, Zone

from . import recordings as R
from .test_recordings import put

DAY = 10 * 86_400_000_000


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("indexed")
    plain = b"".join(R.record("receive", R.irig(i * 1000), rt=i // 100 % 30, n=10) for i in range(3000)) + R.END
    return [put(folder, "a", plain), put(folder, "b", R.random_recording(5, 300, 4)), put(folder, "c", b"".join(R.record("transmit", R.standard(i * 9), rt=2, n=3) for i in range(200)) + R.END)]


@pytest.fixture(scope="module")
def kept(spark, files, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "table")
    index.GROUP, before = 10, index.GROUP  # several groups
    index.write_index(spark, files, folder, 4000)
    index.GROUP = before
    return folder


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.filter("kind <> 'status'").drop("file_index").collect()))


def test_the_whole_by_its_index(spark, files, kept):
    whole = recording.read_pieces(spark, [p for f in recording.survey_files(spark, files, Options(), 4000) for p in f.pieces])
    assert rows(index.read_indexed(spark, kept, paths=files)) == rows(whole)
    assert len(index.find(spark, kept)) == len(index.find(spark, kept, paths=files)) > 25


@pytest.mark.parametrize("first,until", [(0, 5), (2000, 2010), (2990, None), (None, 3), (50_000, 50_010)])
def test_rows_by_number(spark, files, kept, first, until):
    got = index.read_indexed(spark, kept, paths=files[:1], first=first, until=until).filter("kind = 'rec'")
    assert sorted(r.seq for r in got.collect()) == list(range(3000))[first or 0 : until]
    assert len(index.find(spark, kept, paths=files[:1], first=first, until=until)) <= 2


@pytest.mark.parametrize("select", [
    Selection.of(None, DAY + 500_000, DAY + 600_000), Selection.of(None, DAY + 500_000), Selection.of(None, None, DAY + 5000), Selection.of(Filters(include_rts=(7,))), Selection.of(Filters(exclude_rts=(2, 31))),
    Selection.of(Filters(exclude_types=(2, 4))), Selection.of(Filters(exclude_subaddresses=(2,), include_buses=(0,)), DAY), Selection.of(Filters(include_types=(63,))), Selection((("stamp", ">=", (100,)), ("stamp", "<=", (900,)))),
])
def test_the_index_leaves_what_zones_leave(spark, files, kept, select):
    every = index.find(spark, kept, paths=files)
    want = [p for p in every if p.start >= 0 and select.may_hold(Zone(**p.zone), p.ts_format)]
    assert index.find(spark, kept, select, files) == want
    assert rows(index.read_indexed(spark, kept, select, files).filter("kind = 'rec'")) == rows(recording.read_pieces(spark, every, select).filter("kind = 'rec'"))


def test_ten_records_far_behind_read_little(spark, tmp_path, monkeypatch):
    """Bytes are counted where they are read, in this process."""
    one = b"".join(R.record("receive", R.irig(i), rt=i % 30, n=30) for i in range(2000))
    path = put(tmp_path, "far", one * 120)  # 17 MB; time steps back where it starts over
    folder = str(tmp_path / "index")
    index.write_index(spark, [path], folder)
    assert os.path.getsize(path) > 16 << 20
    pieces = index.find(spark, folder, first=200_000, until=200_010)
    taken, real = [], recording._opened.fetch
    monkeypatch.setattr(recording._opened, "fetch", lambda self, offset, size: taken.append(len(got := real(self, offset, size))) or got)
    reader = recording._Reader({"pieces": __import__("json").dumps([vars(p) for p in pieces])})
    seqs = [s for part in reader.partitions() for b in reader.read(part) for s in b.column("seq").to_pylist()]
    assert set(range(200_000, 200_010)) <= set(seqs) and sum(taken) < 8 << 20
    got = plans.records(index.read_indexed(spark, folder, first=200_000, until=200_010)).filter(F.col("kind") == "rec")
    assert [r.seq for r in got.orderBy("seq").collect()] == list(range(200_000, 200_010))


def test_a_changed_file_is_refused(spark, tmp_path):
    path, folder = put(tmp_path, "x", R.random_recording(3, 50)), str(tmp_path / "index")
    index.write_index(spark, [path], folder, 4000)
    put(tmp_path, "x", R.random_recording(4, 60))
    with pytest.raises(UsageError):
        index.find(spark, folder)
    os.remove(path)
    with pytest.raises(UsageError):
        index.find(spark, folder)


def test_many_small_files_are_few_tasks(spark, files):
    """Pieces of a file that one task surveys are those of many tasks; neither tasks nor the driver's rows grow with pieces."""
    whole = recording.survey_files(spark, files, Options(), 4000)
    for i, f in enumerate(whole):
        own = recording.survey_file(i, files[i], Options(), 4000)
        assert own.pieces == f.pieces and own.status == f.status and (own.back, own.first_back, own.accepted) == (f.back, f.first_back, f.accepted)
    got = recording.read_files(spark, files * 40, 4000)
    assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < 40 * sum(len(f.pieces) for f in whole)
    assert rows(got.filter("file_index < 3")) == rows(recording.read_pieces(spark, [p for f in whole for p in f.pieces]))


def test_small_and_large_files_together(spark, files, monkeypatch):
    monkeypatch.setattr(recording, "WHOLE", os.path.getsize(files[1]))
    got = recording.read_files(spark, files, 4000)
    whole = recording.read_raw(spark, files)
    assert sorted(map(str, got.filter("kind = 'rec'").collect())) == sorted(map(str, whole.filter("kind = 'rec'").collect()))
