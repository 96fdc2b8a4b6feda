import re
import zlib

import numpy as np
import pytest
from busloom.llm import mixing, sharding

from . import cases


def water(sizes):
    """Targets by repeated sharing of what caps cut off."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else left * w[s] / open_w for s in names}
        more = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not more:
            return out
        capped |= more


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 20, None: 5}, {"a": 7}, {"é": 1, "z": 1, "Z": 1}, {None: 3, "a": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark):
    docs = cases.documents(spark, clash=True)
    a, b = mixing.mix(docs), mixing.mix(docs.repartition(3))
    rows = a.collect()
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((r[0] or 0, count(r[1])) for r in cases.rows())
    assert cases.same_rows(a.select("doc_id", "size", "taken"), b.select("doc_id", "size", "taken"))
    sizes = {}
    for r in cases.rows():
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    want = water(sizes)
    for s, t in want.items():
        own = [r for r in rows if r.source == s]
        assert abs(own[0].target - t) < 1e-6 and sum(r.taken for r in own) == round(t) and all(r.taken <= 3 * r.size for r in own) and {r.source_size for r in own} == {sizes[s]}
    times = mixing.schedule(a).collect()
    assert sum(r.words for r in times) == sum(r.taken for r in rows)
    assert all(x.position <= y.position for x, y in zip(times, times[1:], strict=False)) and all(0 <= r.due <= 1 for r in times)
    for s in want:  # what is due before a time is what the integral asks for until then
        own = [r for r in times if r.source == s]
        done = 0
        for r in own:
            assert abs(r.target * (r.due + r.slope * (r.due**2 - r.due)) - done) < 1 + 1e-6 * r.target
            done += r.words
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    assert mixing.mix(cases.nothing(spark)).count() == mixing.apply(cases.nothing(spark)).count() == 0
    first = mixing.first_positions(a).collect()
    assert len(first) == len(rows) and sum(r.n_passes for r in first) == len(times)
    assert sorted(r.first_position for r in first if r.taken) == sorted(round(r.position) for r in times if r["pass"] == 0)
    assert all((r.first_position is None) == (r.taken == 0) for r in first)


def test_a_long_document_does_not_empty_its_source(spark):
    """A source of one document of over twice its target."""
    rows = [(0, "w " * 5000, "c"), *((i, "v " * 200, "a") for i in range(1, 50)), *((100 + i, "u " * 100, "b") for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    out = mixing.apply(docs).groupBy("source").count().collect()
    assert target["c"] < 2500 and {r.source: r["count"] for r in out}.keys() == target.keys()


def test_slots_follow_the_files(spark, tmp_path):
    """A table written in order keeps its order within each shard."""
    path = str(tmp_path / "ordered")
    df = spark.range(3000).selectExpr("id % 700 doc_id", "cast(id as string) text", "(id * 7919) % 3000 position")
    df.repartition(5).orderBy("position").write.parquet(path)
    back = spark.read.option("maxPartitionBytes", "1k").parquet(path)
    rows = sharding.shard(back, 7, keep=("position",), in_file_order=True).collect()
    assert len(rows) == 3000
    for s in range(7):
        own = sorted((r.slot, r.position) for r in rows if r.shard == s)
        assert [a for a, _ in own] == list(range(len(own))) and [b for _, b in own] == sorted(b for _, b in own)


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    for n in (1, 2, 7, 40, 41):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(b[a != b]) == {40} and 0.01 < (a != b).mean() < 0.05
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


@pytest.mark.parametrize("rows_per_bucket", [20_000, 2])
def test_shards(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", rows_per_bucket)
    docs = cases.documents(spark, clash=True)
    rows = sharding.shard(docs, 5).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in cases.rows())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) and r.grown_shard in (r.shard, 5)
    kept = sharding.shard(docs, 5, keep=tuple(docs.columns))
    assert sorted(kept.columns) == sorted({*docs.columns, *sharding.MADE})
    assert cases.same_rows(kept.select("doc_id", *sharding.MADE), sharding.shard(docs, 5))
    assert sharding.shard(cases.nothing(spark)).count() == 0
