import hashlib
import math

import numpy as np
import pytest
from busloom.llm import clustering
from busloom.llm.clustering import Tree, cluster

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def slow(rows, k, rounds, seed, dims, scale=1024):
    """Plain Python, whole numbers of any size."""
    own = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    told = sorted(own, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in told[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        label = [nearest(v)[0] for _, v in own]
        centroids = [[sum(x) // len(x) for x in zip(*mine)] if (mine := [v for (_, v), at in zip(own, label) if at == c]) else old for c, old in enumerate(centroids)]
    last = [nearest(v) for _, v in own]
    each = {c: sum(d for at, d in last if at == c) for c in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, each[c], sum(each.values()), sha[c]) for (i, _), (c, d) in zip(own, last)), key=repr)


def points(n, dims, groups, seed=0, spread=0.02):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dims))
    return [(i, (centre[r.integers(groups)] + spread * r.normal(size=dims)).tolist()) for i in range(n)]


def test_against_plain_python(spark):
    rows = points(700, 4, 5) + [(1, [0.5, 0.5, 0.5, 0.5])] * 40 + [(None, [0.1, 0.2, 0.3, 0.4]), (None, None), (3, [1.0]), (4, [None, 1.0, 1.0, 1.0]), (5, [float("nan"), 1.0, 1.0, 1.0]), (6, [float("inf")] * 4), (7, [-0.0, 1e-300, -1e-300, 0.0]), (8, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in cluster(df, k=6, rounds=5, dims=4).collect()), key=repr)
    assert got == slow(rows, 6, 5, 3, 4)


def test_large_components_are_exact(spark):
    rows = [(i, [((-1) ** i) * (1.2e5 + i), 1.3e5 - i * 7]) for i in range(30)]
    got = sorted((tuple(r) for r in cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, rounds=4, dims=2).collect()), key=repr)
    assert got == slow(rows, 3, 4, 3, 2)


@pytest.mark.parametrize("value", [131072.0, -1e300])
def test_components_that_leave_64_bits_are_refused(spark, value):
    df = spark.createDataFrame([(1, [value, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leave 64 bits"):
        cluster(df, dims=2).collect()


def test_few_or_no_vectors(spark):
    assert cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 2.0])]
    got = sorted((tuple(r) for r in cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=2).collect()), key=repr)
    assert got == slow(rows, 8, 10, 3, 2)


@pytest.mark.parametrize("seed", range(6))
def test_balls_are_given_away_rightly_and_often(seed):
    p = np.array([[math.floor(1024 * x) for x in v] for _, v in points(3000, 8, 6, seed)], np.int64)
    tree, order = Tree.of(p)
    assert (tree.points == p[order]).all()
    centroids = np.floor(1024 * np.random.default_rng(seed).normal(size=(6, 8))).astype(np.int64)  # where the groups are
    want = ((p[:, None] - centroids[None]) ** 2).sum(2)
    label, distance = Tree.unpack(*tree.pack(), 8).labels(centroids)
    assert (label == want[order].argmin(1)).all() and (distance == want[order].min(1)).all()
    n, total, by_ball = tree.sums(centroids)
    assert (n == np.bincount(want.argmin(1), minlength=6)).all() and all((total[k] == p[want.argmin(1) == k].sum(0)).all() for k in range(6))
    assert by_ball > len(p) / 2  # groups apart: most vectors are never looked at


def test_ties_go_to_the_smaller_number():
    tree, order = Tree.of(np.array([[x, 0] for x in (-2, 0, 2)] * 50, np.int64), leaf=4)
    label, _ = tree.labels(np.array([[-1, 0], [1, 0], [-1, 0]], np.int64))
    assert (label[tree.points[:, 0] == 0] == 0).all() and (label[tree.points[:, 0] == -2] == 0).all() and (label[tree.points[:, 0] == 2] == 1).all()


def test_trees_do_not_depend_on_how_rows_are_split(spark):
    rows = points(500, 4, 3, 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [sorted(map(tuple, cluster(df.repartition(n), k=4, rounds=3, dims=4).collect())) for n in (1, 7)]
    assert got[0] == got[1]


def test_a_round_counts_each_vector_once(spark):
    v = clustering.kept(spark.createDataFrame(points(900, 4, 3), "vec_id long, embedding array<double>"), "vec_id", "embedding", 4)
    forest = clustering.trees(v, 4, block=200)
    assert forest.selectExpr("size(ids) n").groupBy().sum("n").first()[0] == 900
    _, by_ball = clustering.step(forest, clustering.first_centroids(v, 3))
    assert 0 <= by_ball <= 900
