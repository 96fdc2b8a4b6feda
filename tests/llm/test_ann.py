import numpy as np
import pyarrow as pa
import pytest
from busloom.llm import ann


def test_hilbert_is_a_curve():
    for n, bits in ((2, 3), (3, 2)):
        pts = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        keys = ann.hilbert(pts, bits)
        assert sorted(keys.tolist()) == list(range(len(pts)))
        walk = pts[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute(rows, every, k):
    """All rows against all queries: (id, score) of the nearest, a list for each row that is a query, by its id."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i % every == 0:
            scored = sorted(((-float(ann.dots(q[None], v[None])[0]), j) for other, (j, v) in enumerate(ok) if other != at and len(v) == len(q)))
            out.append((i, [(j, -s) for s, j in scored[:k]]))
    return sorted(out)


def found(df):
    """The same of a result; the queries of one id are told apart by their ranks."""
    out = {}
    for x in df.orderBy("query_id", "rank", "vec_id", "score").collect():
        out.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    return {q: sorted(x) for q, x in out.items()}


def wanted(rows, every, k):
    out = {}
    for q, near in brute(rows, every, k):
        out.setdefault(q, []).extend((r + 1, j, s) for r, (j, s) in enumerate(near))
    return {q: sorted(x) for q, x in out.items() if x}


@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, monkeypatch, seed):
    """Ties over the edges of windows and pieces, repeated rows and ids, vectors of several lengths, and rows that take no part."""
    monkeypatch.setattr(ann, "PIECE_BYTES", 256 * 48)
    monkeypatch.setattr(ann, "QUERIES", 16)
    monkeypatch.setattr(ann, "WINDOW", 32)
    r = np.random.default_rng(seed)
    v = r.standard_normal((900, 6)).astype(np.float32)
    v[50:420] = v[49]  # ties, more than a piece holds
    row = lambda i: (i, [float(x) for x in v[i]])
    rows = [row(i) for i in range(900)]
    rows += [row(3), row(3), row(60), row(500), (60, [float(x) for x in v[7]])]  # repeated rows, and a query's id on another vector
    rows += [(1000, None), (1001, [0.0] * 6), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] + [1.0] * 5), (1060, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (1100, [])]
    rows += [(1080, [1.0] * 3), (1081, [2.0, 0.0, 1.0]), (-20, [0.5] * 3), (2000, [1.0, 1.0])]  # other lengths; the last is alone
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as part", "4 as score", "5 as rid", "6 as q")
    assert found(ann.search(df)) == wanted(rows, 20, 20)


def test_floats_are_ranked_as_doubles(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((300, 5)).astype(np.float32)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(ann.search(df)) == wanted(rows, 20, 20)
    whole = [(i, [i % 7, 1, i]) for i in range(50)]
    assert found(ann.search(spark.createDataFrame(whole, "vec_id long, embedding array<int>"))) == wanted(whole, 20, 20)


def test_few_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (1, [0.5, 0.5]), (40, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df).collect()))
    assert got == [(20, 1, 40, 2.0), (20, 2, 1, 1.5), (40, 1, 20, 2.0), (40, 2, 1, 0.5)]
    assert ann.search(df.limit(0)).count() == ann.search(df.filter("vec_id = 1")).count() == ann.search(df.selectExpr("vec_id", "cast(null as array<double>) embedding")).count() == 0


def recall(spark, v):
    """The share of the 20 nearest that the windows find on their own."""
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float64()))}))
    got = {}
    for x in ann.search(df, exact=False).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    g = v[::20] @ v.T
    g[np.arange(len(g)), np.arange(0, len(v), 20)] = -9
    want = np.argpartition(-g, 20, axis=1)[:, :20]
    return np.mean([len(got[20 * i] & set(w.tolist())) / 20 for i, w in enumerate(want)])


@pytest.mark.parametrize("n", [20_000, 50_000])
def test_windows_recall_even_vectors(spark, n):
    """The windows alone find most neighbours of vectors that spread evenly in 64 dimensions."""
    v = np.random.default_rng(n).standard_normal((n, 64))
    got = recall(spark, v / np.linalg.norm(v, axis=1)[:, None])
    assert got >= 0.9


def test_windows_recall_groups(spark, monkeypatch):
    """Where vectors lie in groups, windows of a hundredth of the table are enough."""
    monkeypatch.setattr(ann, "WINDOW", 64)
    r = np.random.default_rng(5)
    v = np.repeat(r.standard_normal((600, 32)), 30, axis=0) + 0.05 * r.standard_normal((18_000, 32))
    got = recall(spark, v / np.linalg.norm(v, axis=1)[:, None])
    assert got >= 0.9


def test_smallest_hashes(spark):
    from busloom.llm.common import smallest
    from pyspark.sql import functions as F

    df = spark.range(20_000)
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(400).collect()]
    assert [r.id for r in smallest(df, "id", 400, 20_000).collect()] == want
    assert smallest(df.limit(5), "id", 400, 5).count() == 5
