"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint has 64 bits; bit b is 1 if over half of the XXH64 hashes of its 4-word shingles have it. Fingerprints
that differ in at most RADIUS bits are linked, and linked fingerprints form components.

Candidates: 64 bits are cut into f > RADIUS fields. Two fingerprints within the radius agree on at least f - RADIUS whole
fields, so each distinct fingerprint is dealt to one bucket for each group of f - RADIUS fields, and no link is lost. f grows
with the number of fingerprints, which keeps random buckets near one row at any size. All comparing is bit-sliced:
fingerprints are stored as bit planes, of which one machine word holds one bit of 64 fingerprints, and carry-save counters add up
the differing bits of 64 pairs at once; a block of pairs is abandoned once all its counters exceed the radius.
Small buckets, from two rows up, are compared many at a time: the planes of a whole batch of buckets are set against themselves,
shifted by one row, by two and so on up to the widest bucket, and pairs of different buckets start abandoned. In larger buckets
each fingerprint is set against the whole plane set. A bucket returns a spanning forest of its links, so a group of n near
copies never makes more than n - 1 rows in a bucket. Buckets over BLOCK fingerprints are split into pairs of blocks, dealt to separate tasks.

Components come from alternating star contractions over the links, between written checkpoints; nothing is collected. A node
carries the smallest id of its fingerprint and nodes are ordered by it, so the root of a component tells its smallest id and no
join on components is needed. Nodes, and fingerprints, that hold over a thousandth of the rows of a join are joined where they stand.

A null or empty text, and one of white space only, has fingerprint zero, linked like any other. Fewer than 4 words make one
shingle. Equal texts share a fingerprint and are compared once. Null ids take part; the smallest id ignores them. Columns
other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, checkpointed, hot_keys, identities, map_texts, spread_join

RADIUS = 4
#: Fingerprints of a bucket that one task compares with another block.
BLOCK = 4096
#: Rows of a bucket up to which it is compared together with others.
SMALL = 64
_CHUNK = 1 << 15
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text."""
    words = text.encode("utf-8", "replace").translate(LOWER_BYTES).split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return int.from_bytes(digest(b" ".join(words), seed=42), "big")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    stops = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    n = len(starts)
    for i in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp (64 bits as a signed long) of each row."""

    def make():
        def apply(texts: list) -> list:
            return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist()]

        return apply

    return map_texts(documents, keys, text, make, "fp bigint")


def fields(n: int) -> list[tuple[int, int]]:
    """First bit and width of n fields that cover 64 bits."""
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of uint64 fingerprints: plane b holds bit b of each, 64 to a word, padded with zeros."""
    n = len(fps)
    bits = np.zeros((64, -(-n // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class _Counters:
    """Carry-save counters of differing bits for blocks of 64 pairs: three bit planes, and a fourth in which what passes the radius sticks."""

    def __init__(self, over: np.ndarray, radius: int) -> None:
        self.over, self.radius = over, radius
        self.c0, self.c1, self.c2 = (np.zeros_like(over) for _ in range(3))

    def add(self, x: np.ndarray, others: list[np.ndarray]) -> None:
        """Add one differing bit of each pair, or three."""
        if others:
            y, z = others
            s = x ^ y
            carry = (x & y) | (s & z)
            s ^= z
        else:
            s, carry = x, np.zeros_like(x)
        k = self.c0 & s
        self.c0 = self.c0 ^ s
        t = self.c1 ^ carry
        k2 = (self.c1 & carry) | (t & k)
        self.c1 = t ^ k
        self.over = self.over | (self.c2 & k2)
        self.c2 = self.c2 ^ k2
        self.over = self.over | _above(self.c0, self.c1, self.c2, self.radius)

    def abandon(self) -> np.ndarray | None:
        """Leave out the blocks that are all over; which are kept, or None for all."""
        keep = self.over != _ONES
        if keep.all():
            return None
        self.c0, self.c1, self.c2, self.over = (v[keep] for v in (self.c0, self.c1, self.c2, self.over))
        return keep


def _count(blocks: list[np.ndarray], over: np.ndarray, differ, radius: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What is left of the blocks (arrays that name them), and the pairs of each within the radius. differ(plane, *blocks) gives differing bits."""
    counters = _Counters(over, radius)
    for step, b in enumerate(range(0, 64, 3)):
        if step % 4 == 0 and (keep := counters.abandon()) is not None:
            blocks = [x[keep] for x in blocks]
        if not len(counters.over):
            break
        x, *others = [differ(i, *blocks) for i in range(b, min(b + 3, 64))]
        counters.add(x, others)
    if (keep := counters.abandon()) is not None:
        blocks = [x[keep] for x in blocks]
    return blocks, ~counters.over


def within(fps: np.ndarray, cols: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where fingerprints come within the radius of the columns of a plane set: row, word and bit mask of each such word."""
    blocks = [x.ravel() for x in np.indices((len(fps), cols.shape[1]))]
    flips = [np.where(fps >> np.uint64(b) & np.uint64(1), _ONES, np.uint64(0)) for b in range(64)]
    (row, word), mask = _count(blocks, np.zeros(len(blocks[0]), np.uint64), lambda b, row, word: cols[b][word] ^ flips[b][row], radius)
    return row, word, mask


def near_in_groups(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one group within the radius; rows of a group stand together, SMALL at most. One pair of arrays for each shift."""
    cols = planes(fps)
    n, words = len(fps), cols.shape[1]
    widest = int(np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))).max()) if n else 0
    for shift in range(1, min(widest, SMALL)):
        ahead = np.concatenate([cols[:, 1:], np.zeros((64, 1), np.uint64)], axis=1)
        moved = (cols >> np.uint64(shift)) | (ahead << np.uint64(64 - shift))
        apart = np.ones(words * 64, np.uint8)
        apart[: n - shift] = group[shift:] != group[:-shift]
        over = np.packbits(apart, bitorder="little").view(np.uint64)
        (word,), mask = _count([np.arange(words)], over, lambda b, word, moved=moved: cols[b][word] ^ moved[b][word], radius)
        w, bit = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i = word[w] * 64 + bit
        yield i, i + shift


def _above(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Where a counter of three bits exceeds the radius."""
    return {1: c1 | c2, 2: (c0 & c1) | c2, 3: c2, 4: c2 & (c0 | c1), 5: c2 & c1, 6: c2 & c1 & c0}[radius]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (places) that connect what is linked within left, or between left and right, whose places follow those of left."""
    n = len(left) + (0 if right is None else len(right))
    shift = 0 if right is None else len(left)
    cols = planes(left if right is None else right)

    def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(left), 64):
            row, word, mask = within(left[at : at + 64], cols, radius)
            w, b = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = row[w] + at, word[w] * 64 + b + shift
            real = (j < n) & (i < j)
            yield i[real], j[real]

    return spanning(linked(), n) if n > 1 else []


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of n places."""
    root = list(range(n))
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        if len(i) > 64:  # pairs that are connected by now go at once
            top = np.array(root)
            while (up := top[top]).tobytes() != top.tobytes():
                top = up
            new = top[i] != top[j]
            i, j = i[new], j[new]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def _compare(radius: int):
    """Compare the buckets of a partition sorted by bucket; a bucket's rows are held together, at most 2 * BLOCK of them."""

    def links(t: pa.Table) -> pa.RecordBatch:
        k, side, fp = (t.column(c).to_numpy() for c in ("k", "side", "fp"))
        fp = fp.view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        size = np.diff(cuts)
        # most buckets hold one row: nothing to compare. Small ones go together
        small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL) & (side[cuts[:-1]] == 0), size))
        found = [(small[i], small[j]) for i, j in near_in_groups(fp[small], k[small], radius)] if len(small) else []
        pairs = spanning(iter(found), len(k))
        for lo, n in zip(cuts[:-1].tolist(), size.tolist(), strict=True):
            if n == 1 or n <= SMALL and not side[lo]:
                continue
            x, s = fp[lo : lo + n], side[lo : lo + n]
            if not s[0]:
                pairs += [(lo + i, lo + j) for i, j in forest(x, None, radius)]
            elif s[0] != s[-1]:  # 1 and 2: two blocks of a split bucket
                pairs += [(lo + i, lo + j) for i, j in forest(x[s == 1], x[s == 2], radius)]
        a, b = (pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1))
        own = [t.column(c).take(x).combine_chunks() for x in (a, b) for c in ("fp", "least")]
        return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in own], ["a", "a_least", "b", "b_least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            cut = len(k) - int(np.argmin((k == k[-1])[::-1])) if k[0] != k[-1] else 0
            if cut or rest and rest[-1].column(0)[-1].as_py() != k[0]:
                yield links(pa.Table.from_batches([*rest, *([batch.slice(0, cut)] if cut else [])]).combine_chunks())
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield links(pa.Table.from_batches(rest).combine_chunks())

    return run


def plan(n: int, radius: int = RADIUS) -> tuple[int, list[tuple[int, ...]]]:
    """The groups of fields that make bucket keys: so many fields that n fingerprints spread over more buckets than rows."""
    f = next((f for f in range(radius + 2, radius + 5) if 1 << (64 * (f - radius) // f) >= n), radius + 5)
    return f, list(combinations(range(f), f - radius))


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose connected components are those of all distinct fingerprints (fp, least) within the radius.

    A node is a struct (none, least, fp), ordered by the smallest id of a fingerprint, those without an id last.
    """
    if not 1 <= radius <= 6:
        raise ValueError("radius: 1 to 6")
    spark = distinct.sparkSession
    f, groups = plan(distinct.count(), radius)
    cut = fields(f)

    def key(number: int, group: tuple[int, ...]) -> str:
        value = "0L"
        for i in group:
            first, width = cut[i]
            value = f"(shiftleft({value}, {width}) | (shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L))"
        return f"xxhash64({number}, {value})"  # buckets that collide are merely compared together

    dealt = distinct.select("fp", "least", F.explode(F.expr(f"array({', '.join(key(*g) for g in enumerate(groups))})")).alias("k"))
    big = checkpointed(dealt.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > block).select(F.col("k").alias("k2"), F.expr(f"cast(ceil(n / {block / 2}) as int)").alias("parts")))
    hot = big.count()
    plain = dealt.select("k", F.lit(0).alias("side"), "fp", "least")
    if hot:
        own = F.broadcast(big) if hot <= 100_000 else big  # 100,000 rows of 12 bytes at most
        on = F.col("k") == F.col("k2")
        split = dealt.join(own, on).withColumn("own", F.expr("cast(pmod(xxhash64(fp, k), parts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        split = split.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), side.alias("side"), "fp", "least")
        plain = dealt.join(own, on, "left_anti").select("k", F.lit(0).alias("side"), "fp", "least").unionByName(split)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = distinct.schema["least"].dataType.simpleString()
    found = plain.repartition(parts, "k").sortWithinPartitions("k", "side").mapInArrow(_compare(radius), f"a bigint, a_least {kind}, b bigint, b_least {kind}")
    return found.select(node("a_least", "a").alias("a"), node("b_least", "b").alias("b"))


def node(least: str, fp: str) -> Column:
    return F.struct(F.col(least).isNull().alias("none"), F.col(least).alias("least"), F.col(fp).alias("fp"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of every node of the edges (a, b).

    Alternating large and small stars (Kiveris et al., 2014): each round links the neighbours of a node to their minimum.
    The links of a round are aggregated before they are shuffled and written to the shared folder, so lineage stays short. The
    centre of a large star is a hot key of each round, and is treated so.
    """
    links = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    total, before = links.count(), None
    for _ in range(most):
        if not total:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        hot = hot_keys(least, "u", "n", 2 * total)
        large = checkpointed(spread_join(both.filter("v > u"), least.drop("n"), "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        small = checkpointed(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        hot = hot_keys(small, "u", "n", 2 * total)
        small = small.drop("n")
        linked = spread_join(large, small, "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(linked.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        total, before = state.n, state
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def marked(documents: DataFrame, key: str, text: str, radius: int) -> DataFrame:
    """key, identities, fp, root (a node: least id and fp) of each row."""
    picked = documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__t")).withColumns({"__id1": identities("__key", "__t")[0], "__id2": identities("__key", "__t")[1]})
    rows = checkpointed(fingerprints(picked, ["__key", "__id1", "__id2"], "__t"))
    least = checkpointed(rows.groupBy("fp").agg(F.min("__key").alias("least"), F.count("*").alias("n")))
    roots = components(links(least.select("fp", "least"), radius)).select(F.col("node.fp").alias("__fp"), "root")
    named = checkpointed(least.join(roots, F.col("fp") == F.col("__fp"), "left").select("fp", "n", F.coalesce("root", node("least", "fp")).alias("root")))
    return spread_join(rows, named.drop("n"), "fp", hot_keys(named, "fp", "n", rows.count()))


def components_of(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fp and component_id of each row; component_id is the smallest key of the rows that links reach."""
    return marked(documents, key, text, radius).select(F.col("__key").alias(key), "fp", F.col("root.least").alias("component_id"))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all columns: that with the smallest key (nulls last), then the smallest text hash."""
    order = F.struct(F.col("__key").isNull(), F.col("__key"), F.col("__id1"), F.col("__id2"))
    best = marked(documents, key, text, radius).groupBy("root").agg(F.min(order).alias("best"))  # aggregated before the shuffle
    wanted = best.select(F.col("best.__id1").alias("__w1"), F.col("best.__id2").alias("__w2"))
    own = documents.select("*", *identities(key, text))
    kept = own.join(wanted, (F.col("__id1") == F.col("__w1")) & (F.col("__id2") == F.col("__w2"))).drop("__w1", "__w2")
    rest = [c for c in documents.columns if c not in (key, text)]
    one = Window.partitionBy("__id1", "__id2").orderBy(F.xxhash64(*rest) if rest else F.lit(0))
    return kept.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n", "__id1", "__id2")
