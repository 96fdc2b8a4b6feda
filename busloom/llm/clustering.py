"""Exact k-means over integer vectors, filtered by ball trees.

Each task packs its rows into blocks and builds a metric tree for each: a node has a centre, a radius, a count and the exact
integer sum of its vectors. Trees are written once to the shared folder. In a round a tree is walked level by level: if, by
the triangle inequality, a centroid is nearer than any other to all of a ball (the distances from the ball's centre differ by more
than its diameter), the whole ball goes to it by count and sum; else its two halves are looked at, and a leaf's vectors are
compared exactly, in integers. Bounds carry a margin for rounding, so a ball is never given away wrongly. Only sums by cluster
leave a task: a round moves k x (dimensions + 1) numbers a task, and centroids (k vectors) are all that the driver holds.

Vectors take part if they have the wanted number of components, none null or not finite. Each component x becomes floor(scale * x);
one of LIMIT or more in size is an error, as squared distances would leave 64 bits. The first centroids are the k vectors with the
smallest sha256 of "<seed>:<id>"; ids that are null come last, and equal ids are told apart by their vectors. Fewer vectors than k make
fewer centroids, none an empty result. Repeated rows each count. Ties of distance go to the smaller number. A
centroid without vectors stays. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMS, SCALE, SEED, CLUSTERS, ROUNDS = 64, 1024, 3, 8, 10
#: Vectors of a tree, and of a leaf, at most.
BLOCK, LEAF = 4096, 32
#: Components from here on are refused: 64 squares of differences below 2 * LIMIT stay under 2**63.
LIMIT = 1 << 27
#: Components up to here have exact distances in double precision.
_EXACT = 1 << 21


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)  # all sums are whole numbers below 2**53
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


@dataclass
class Tree:
    """Points in the order of the tree's leaves; of each node its range of points, halves (0: none), radius and sum."""

    points: np.ndarray
    first: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree of some points, and the order it has put them in."""
        order = np.arange(len(points))
        nodes: list[list] = []
        stack = [(0, len(points), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            own = points[order[lo:hi]]
            total = own.sum(0)
            away = own - total / (hi - lo)
            far = (away * away).sum(1)
            radius = float(np.sqrt(far.max()))
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            nodes.append([lo, hi, 0, 0, radius, total])
            if hi - lo > leaf and radius > 0:
                one = own[far.argmax()]
                gap = (own - one).astype(np.float64)
                other = own[(gap * gap).sum(1).argmax()]
                along = gap @ (other - one).astype(np.float64)
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(along, mid)]
                stack += [(lo + mid, hi, len(nodes) - 1, 3), (lo, lo + mid, len(nodes) - 1, 2)]
        first, end, left, right = (np.array([n[i] for n in nodes], np.int64) for i in range(4))
        return cls(points[order], first, end, left, right, np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes], np.int64)), order

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, np.ndarray]]]:
        """Whole balls as (node, cluster), and leaves as (first, end, clusters of its points)."""
        balls: list[tuple[int, int]] = []
        leaves: list[int] = []
        open_ = np.zeros(1, np.int64)
        c = centroids.astype(np.float64)
        while len(open_):
            centre = self.total[open_] / (self.end[open_] - self.first[open_])[:, None]
            apart = np.sqrt(((centre[:, None, :] - c[None]) ** 2).sum(2))
            best = apart.argmin(1)
            nearest = apart[np.arange(len(open_)), best]
            apart[np.arange(len(open_)), best] = np.inf
            second = apart.min(1)
            # a relative margin far above what doubles lose here, and an absolute one for distances near zero
            margin = 1e-9 * (nearest + np.where(np.isinf(second), 0, second) + self.radius[open_]) + 1e-6
            whole = second - nearest > 2 * self.radius[open_] + margin
            balls += zip(open_[whole].tolist(), best[whole].tolist(), strict=True)
            rest = open_[~whole]
            end = self.left[rest] == 0
            leaves += rest[end].tolist()
            open_ = np.concatenate([self.left[rest[~end]], self.right[rest[~end]]])
        if not leaves:
            return balls, []
        at = np.concatenate([np.arange(self.first[n], self.end[n]) for n in leaves])
        label = squared(self.points[at], centroids).argmin(1)
        cuts = np.cumsum([self.end[n] - self.first[n] for n in leaves])[:-1]
        return balls, [(int(self.first[n]), int(self.end[n]), x) for n, x in zip(leaves, np.split(label, cuts), strict=True)]

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Count and sum by cluster, and how many points went by whole balls."""
        n = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)
        balls, leaves = self.assign(centroids)
        for node, k in balls:
            n[k] += self.end[node] - self.first[node]
            total[k] += self.total[node]
        by_ball = int(n.sum())
        for lo, hi, label in leaves:
            n += np.bincount(label, minlength=len(centroids))
            np.add.at(total, label, self.points[lo:hi])
        return n, total, by_ball

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each point."""
        label = np.zeros(len(self.points), np.int64)
        balls, leaves = self.assign(centroids)
        for node, k in balls:
            label[self.first[node] : self.end[node]] = k
        for lo, hi, own in leaves:
            label[lo:hi] = own
        gap = self.points - centroids[label]
        return label, (gap * gap).sum(1)

    def pack(self) -> list[bytes]:
        nodes = np.stack([self.first, self.end, self.left, self.right], axis=1)
        return [self.points.astype(np.int32).tobytes(), nodes.tobytes(), self.radius.tobytes(), self.total.tobytes()]

    @classmethod
    def unpack(cls, points: bytes, nodes: bytes, radius: bytes, total: bytes, dims: int) -> Tree:
        at = np.frombuffer(nodes, np.int64).reshape(-1, 4)
        return cls(np.frombuffer(points, np.int32).reshape(-1, dims).astype(np.int64), *(at[:, i] for i in range(4)), np.frombuffer(radius), np.frombuffer(total, np.int64).reshape(-1, dims))


_PARTS = "points binary, nodes binary, radius binary, total binary"


def kept(embeddings: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id and v (whole numbers, as doubles) of the vectors that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fine = embeddings.select(F.col(f"`{key}`").alias("id"), v.alias("v")).filter((F.size("v") == dims) & ~bad)
    return fine.withColumn("v", F.expr(f"transform(v, x -> cast({scale} as double) * x)"))


def _floored(values: np.ndarray) -> np.ndarray:
    v = np.floor(values)
    if np.abs(v).max(initial=0) >= LIMIT:
        raise ValueError(f"a scaled component is {LIMIT} or more in size: squared distances would leave 64 bits")
    return v.astype(np.int64)


def trees(vectors: DataFrame, dims: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each tree: ids in the order of its points, and its parts."""
    kind = vectors.schema["id"].dataType.simpleString()

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column(1).chunks]).reshape(-1, dims)
        tree, order = Tree.of(_floored(values), leaf)
        ids = t.column(0).take(pa.array(order)).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b], pa.binary()) for b in tree.pack())], ["ids", "points", "nodes", "radius", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, block - rows)
                held.append(part)
                rows += part.num_rows
                b = b.slice(part.num_rows)
                if rows == block:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)

    return vectors.mapInArrow(run, f"ids array<{kind}>, {_PARTS}")


def _trees_of(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array | None, Tree]]:
    for b in batches:
        at = {n: i for i, n in enumerate(b.schema.names)}
        for r in range(b.num_rows):
            ids = b.column(at["ids"]).slice(r, 1).flatten() if "ids" in at else None
            yield ids, Tree.unpack(*(b.column(at[c])[r].as_py() for c in ("points", "nodes", "radius", "total")), dims)


def step(forest: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after one round, and how many vectors went by whole balls."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, by_ball = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for _, tree in _trees_of(batches, dims):
            a, b, c = tree.sums(centroids)
            n, total, by_ball = n + a, total + b, by_ball + c
        # place: cluster * (dims + 1) for the count, then the components; the last for the balls
        values = np.append(np.concatenate([n[:, None], total], axis=1).ravel(), by_ball)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.int64())], ["place", "value"])

    found = forest.select("points", "nodes", "radius", "total").mapInArrow(run, "place int, value bigint").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    values = [0] * (k * (dims + 1) + 1)
    for r in found:
        values[r.place] = int(r.value)
    out = centroids.copy()
    for i in range(k):
        n, *total = values[i * (dims + 1) : (i + 1) * (dims + 1)]
        if n:
            out[i] = [s // n for s in total]  # whole numbers of any size, rounded down
    return out, values[-1]


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hash of their id."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.withColumn("h", told).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()
    return _floored(np.array([r.v for r in rows], np.float64)) if rows else np.zeros((0, 0), np.int64)


def cluster(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    vectors = kept(embeddings, key, vector, dims, scale)
    kind = vectors.schema["id"].dataType.simpleString()
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select(F.col("id").alias(key), *(F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")))).filter("false")
    forest = written(trees(vectors, dims))
    for _ in range(rounds):
        centroids, _ = step(forest, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees_of(batches, dims):
            label, distance = tree.labels(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    found = written(forest.mapInArrow(run, f"id {kind}, cluster int, distance bigint"))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    place = F.col("cluster") + 1
    of = F.array(*(F.lit(sums.get(i, 0)).cast("long") for i in range(len(centroids))))
    told = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()))
    return found.select(F.col("id").alias(key), "cluster", "distance", F.element_at(of, place).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.element_at(told, place).alias("centroid_sha256"))
