import os
import zlib
from pathlib import Path

import numpy as np
import pytest
from busloom.llm import token_shards as T

from . import cases

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    p = T.Permutation(n, 7)
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and p.numbers(slots).tolist() == list(range(n))
    if n == 1000:
        assert (slots != T.Permutation(n, 8).slots(np.arange(n))).mean() > 0.9 and abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.2


def contents(folder):
    """The bytes of each shard."""
    found = {}
    for f in Path(folder).glob("shard=*/part-*"):
        shard = int(f.parent.name.split("=")[1])
        assert shard not in found
        found[shard] = f.read_bytes()
    return found


def test_round_trip(spark, tmp_path):
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.vocabulary(T.VOCABULARY), special_tokens={})
    docs = cases.documents(spark, clash=True)
    rec = T.records(docs, length=64, per_shard=50)
    rows = rec.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    folder = str(tmp_path / "out")
    shards = sorted(T.write_shards(rec, folder).collect(), key=lambda r: r.shard)
    stride = T.stride_of(64)
    files = contents(folder)
    assert [s.bytes for s in shards] == [stride * s.n_records for s in shards] and all(s.n_records == 50 for s in shards[:-1])
    assert {s.shard: s.crc32 for s in shards} == {k: zlib.crc32(v) for k, v in files.items()} and len(files) == -(-len(rows) // 50)
    assert [s[0] for s in T.manifest(spark, folder)["shards"]] == sorted(files)
    back = {}
    for r in rows:
        assert r.shard == r.slot // 50 and r.position == r.slot % 50 * stride
        raw = files[r.shard][r.position : r.position + stride]
        assert raw == bytes(r.record) + b"\n"
        n = int.from_bytes(raw[:4], "little")
        back.setdefault(r.number - r.part, {})[r.part] = (r.doc_id, np.frombuffer(raw[4 : 4 + 2 * n], "<u2"))
    texts = sorted(((parts[0][0], coder.decode([int(t) for p in sorted(parts) for t in parts[p][1]][:-1])) for parts in back.values()), key=str)
    assert texts == sorted(((r[0], r[1] or "") for r in cases.rows()), key=str)
    some = rows[:: max(1, len(rows) // 5)]
    for r, got in zip(some, T.read_records(spark, folder, [r.slot for r in some], 50), strict=True):
        assert got.tobytes() == bytes(r.record)[4 : 4 + 2 * r.n_tokens]


def test_rewritten_shards(spark, tmp_path):
    """The bytes follow from rows and seed alone; what another seed or a longer input left goes."""
    docs = cases.documents(spark)
    folder = str(tmp_path / "out")
    write = lambda df, seed: (T.write_shards(T.records(df, length=64, per_shard=50, seed=seed), folder), contents(folder))[1]
    one = write(docs, 7)
    assert write(docs.repartition(5, "n_chars").coalesce(2), 7) == one
    other = write(docs, 8)
    assert other.keys() == one.keys() and all(other[k] != one[k] for k in one)
    assert len(write(docs.filter("doc_id < 4"), 8)) == 1
    assert write(cases.nothing(spark), 8) == {} and T.manifest(spark, folder)["shards"] == []
    assert T.records(cases.nothing(spark)).count() == 0


def slow_slot(number, n, key, rounds=6):
    """The permutation on plain numbers, round by round."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    full = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    while True:
        left, right = number >> half, number & (1 << half) - 1
        for r in range(rounds):
            k = key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03 & full
            left, right = right, left ^ mix(right + k & full) & (1 << half) - 1
        number = left << half | right
        if number < n:
            return number


def test_slots_follow_the_hash_of_key_and_text(spark):
    """Numbers by a plain sort on the driver, slots by plain arithmetic."""
    from pyspark.sql import functions as F

    docs = cases.documents(spark)
    got = sorted((r.number, r.slot, str(r.doc_id)) for r in T.records(docs, length=64, per_shard=50).collect())
    n = len(got)
    assert [g[1] for g in got] == [slow_slot(i, n, 7) for i in range(n)] and [g[0] for g in got] == list(range(n))
    hashed = docs.select(F.col("doc_id"), F.xxhash64("doc_id", F.lit(1), "text").alias("a"), F.xxhash64("text", F.lit(2), "doc_id").alias("b")).collect()
    first = [g[2] for i, g in enumerate(got) if not i or got[i - 1][2] != g[2]]
    want = [str(r.doc_id) for r in sorted(hashed, key=lambda r: (r.a % (1 << 64), r.b))]
    assert first == [w for i, w in enumerate(want) if not i or want[i - 1] != w]
