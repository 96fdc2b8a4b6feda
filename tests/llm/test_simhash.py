import random

import numpy as np
import pytest
import xxhash
from busloom.llm import simhash as S

from . import cases


def brute_fp(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = raw.split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def clustered(seed, n, centres=20, spread=6):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(centres)]
    return np.unique(np.array([r.choice(base) ^ sum({1 << r.randrange(64) for _ in range(r.randrange(spread))}) for _ in range(n)], np.uint64))


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5, 6])
def test_forest(radius):
    x = clustered(radius, 700)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    links = S.forest(x, None, radius)
    assert all(near[a, b] for a, b in links) and len(links) < len(x)
    assert classes(len(x), links) == classes(len(x), np.argwhere(np.triu(near, 1)).tolist())
    m = 200
    cross = near.copy()
    cross[:m, :m] = cross[m:, m:] = False
    links = S.forest(x[:m], x[m:], radius)
    assert classes(len(x), links) == classes(len(x), np.argwhere(np.triu(cross, 1)).tolist())


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5, 6])
def test_small_buckets_are_compared_together(radius):
    """All pairs within the radius of each bucket, and none of two buckets, whatever the buckets' sizes."""
    r = np.random.default_rng(radius)
    size = r.choice([1, 2, 2, 3, 5, 24, 25, S.SMALL], 150)
    group = np.repeat(r.permutation(150), size)
    x = clustered(radius, 4000, 5)[: len(group)]
    group, x = group[: len(x)], r.permutation(x)
    want = (np.bitwise_count(x[:, None] ^ x[None, :]) <= radius) & (group[:, None] == group[None, :])
    got = [(int(a), int(b)) for i, j in S.near_in_groups(x, group, radius) for a, b in zip(i, j, strict=True)]
    assert len(got) == len(set(got)) and sorted(got) == [tuple(p) for p in np.argwhere(np.triu(want, 1)).tolist()]


def as_links(df):
    """Distinct fingerprints as nodes, whose id is the fingerprint."""
    return df.selectExpr("fp", "fp least")


@pytest.mark.parametrize("block", [4096, 16])
def test_links_and_components(spark, block):
    """With small blocks, buckets are split into pairs of blocks; the components stay the same."""
    x = clustered(9, 500, centres=4)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    want = classes(len(x), np.argwhere(np.triu(near, 1)).tolist())
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    roots = {r.node.fp: r.root.fp for r in S.components(S.links(as_links(df), 4, block)).collect()}
    got = [roots.get(int(v), int(v)) for v in x.view(np.int64)]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_the_kernel_makes_every_link(spark, monkeypatch):
    """Without the bit-sliced counters there are no links, in small buckets or large ones."""
    x = clustered(3, 400, centres=3)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    assert S.links(as_links(df)).count()
    monkeypatch.setattr(S, "_count", lambda blocks, over, differ, radius: ([b[:0] for b in blocks], over[:0]))
    assert not S.links(as_links(df)).count()


def test_fields_cover_more_than_the_radius():
    for n in (10, 10**7, 10**9, 10**12):
        f, groups = S.plan(n)
        assert all(len(g) == f - 4 for g in groups) and sum(w for _, w in S.fields(f)) == 64


def test_documents(spark):
    rows = cases.rows()
    got = S.components_of(cases.documents(spark, clash=True)).collect()
    fps = [brute_fp(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    cls = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {c: min((i for i, k in zip(ids, cls, strict=True) if k == c and i is not None), default=None) for c in set(cls)}
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, least[c]) for i, f, c in zip(ids, fps, cls, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=str) == want
    assert S.components_of(cases.nothing(spark)).count() == 0
    kept = S.keep_one(cases.documents(spark, clash=True))
    assert kept.columns == cases.documents(spark, clash=True).columns and kept.count() == len(set(cls))
    assert S.keep_one(cases.nothing(spark)).count() == 0


def test_chain_of_links(spark):
    """A long chain is one component, whatever the order of its nodes."""
    n = 300
    order = random.Random(1).sample(range(n), n)
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in S.components(df).collect()}
    assert {v for k, v in got.items() if k < n} == {0} and got[1001] == 1000 and len(got) == n + 2
