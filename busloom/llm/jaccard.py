"""Near-duplicates by the Jaccard similarity of word shingles: a grouped prefix join, exact.

A document's set holds the distinct shingles of WIDTH words (fewer words: the whole sequence as one; none: no shingle, linked with
nothing). Two documents link when 100 * |both| >= PERCENT * |either|; linked ones form components. Shingles stand as 64-bit
hashes, and equal sets, told by 128 bits, are one class.

Shingles have one order for all documents: rare ones first, by a table of counters over all documents (CELLS of them, added up in a tree),
then by hash. A set of n shingles and any set it links with share one of the first n - ceil(PERCENT * n / 100) + 1, its prefix. Documents with the same
prefix and size are one group, and only groups are indexed by the shingles of their prefix, so copies and near copies of one prefix cost
one entry a shingle. Groups that meet at a shingle are candidates if sizes, and what is left behind the places of the shingle, allow a link;
then their members are expanded and verified on whole sets.

Where thousands of groups meet at one shingle, all pairs are not written. First each group is tried with the one group of its
shingle that has the fewest rarer shingles before it (the text that near copies come from, which has none of its own): a row for each entry.
Classes that link with one such pivot are connected by it, and all other pairs of classes whose groups meet
are tried by a join: no pair that could join two components is left out. A class is shipped to a pivot for each of its
pairs; a pivot with many of them comes to several tasks, so no task holds all that meet one text.

A null or empty text, or one of white space, has no shingle, and its own id as component. Null ids take part; the smallest id ignores
them. Equal texts, and repeated rows, are compared once. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COUNTERS, LOWER_BYTES, Bloom, bloom, cached, counters, distinct, dropped, hot_keys, map_texts, mixed, pieces, spread_join, tree_sum, word_hashes, written
from .simhash import components

WIDTH, PERCENT = 5, 80
#: Counters of the table that says which shingles are rare, a power of two: 4 MB as they are broadcast, whatever the input.
CELLS = 1 << 22
#: Pairs of one pivot that a task verifies.
PAIRS = 256
#: Pairs up to which the list of who goes where comes to the texts (some 50 MB); beyond, texts are shuffled to it.
FEW_WAYS = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order of hash."""
    words = [t.encode("utf-8", "replace").translate(LOWER_BYTES).split() if t else [] for t in texts]
    ids, numbers = distinct([w for own in words for w in own])
    hashes = word_hashes(ids)[numbers]
    out, at = [], 0
    for own in words:
        w = hashes[at : at + len(own)]
        at += len(own)
        k = min(width, len(own))
        h = np.full(max(len(own) - k + 1, 0) if k else 0, k, np.uint64)
        for j in range(k):
            h = (h ^ (h >> np.uint64(29))) * _STEP + w[j : j + len(h)]
        out.append(np.unique(mixed(h)))
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def linked(both: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (n + m - both)


def rarity(documents: DataFrame, text: str, width: int = WIDTH, cells: int = CELLS) -> np.ndarray:
    """The magnitude (bits) of the count of each cell of shingles."""
    down = np.uint64(64 - cells.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for b in pieces(batches):
            own = shingles(b.column(0).to_pylist(), width)
            if own:
                total += np.bincount((np.concatenate(own) >> down).astype(np.int64), minlength=cells)
        yield counters(total)

    total = tree_sum(documents.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, COUNTERS), cells)
    return np.ceil(np.log2(total + 1)).astype(np.uint8)


def prefixes(documents: DataFrame, text: str, keys: list[str], rare: np.ndarray, width: int, percent: int) -> DataFrame:
    """keys; n, the size of the set; c, its hash; g, the hash of its prefix and size; prefix, in order of rarity."""
    shared = documents.sparkSession.sparkContext.broadcast(rare.tobytes())  # a byte a cell
    down = np.uint64(64 - len(rare).bit_length() + 1)

    def make():
        order = cached(shared, lambda x: np.frombuffer(x, np.uint8))

        def one(h: np.ndarray) -> tuple:
            if not len(h):
                return 0, None, None, None
            first = h[np.lexsort((h, order[(h >> down).astype(np.int64)]))[: prefix_length(len(h), percent)]]
            g = xxhash.xxh3_64_intdigest(first.tobytes(), seed=len(h))
            return len(h), xxhash.xxh3_128_digest(h.tobytes()), g - (1 << 64) if g >> 63 else g, first.view(np.int64)

        def apply(texts: list) -> list:
            return [list(x) for x in zip(*map(one, shingles(texts, width)), strict=True)]

        return apply

    return map_texts(documents, keys, text, make, "n bigint, c binary, g bigint, prefix array<bigint>")


def _verify(documents: DataFrame, text: str, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (p, x) of nodes whose sets link. A text moves once for each of its pairs, straight to where they are verified, and its set is made
    there: packed text has a third of the bytes of its hashes. p moves to a task for each PAIRS of its pairs."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = written(pairs.groupBy("p").agg(F.expr(f"cast(ceil(count(*) / {PAIRS}) as int)").alias("lanes")))
    many = lanes.filter("lanes > 1").select(F.col("p").alias("hot"), "lanes")
    dealt = pairs.join(many, F.col("p") == F.col("hot"), "left").select(F.col("x").alias("node"), "p", F.expr("cast(pmod(xxhash64(x), coalesce(lanes, 1)) as int)").alias("lane"), F.lit(True).alias("member"))
    own = lanes.select(F.col("p").alias("node"), "p", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(False).alias("member"))
    ways = dealt.unionByName(own).groupBy("node").agg(F.collect_list(F.struct("p", "lane", "member")).alias("ways"))
    ways = written(ways.join(classes.select("node", "id1"), "node").select("id1", "node", "ways"))
    if ways.agg(F.coalesce(F.sum(F.size("ways")), F.lit(0))).first()[0] <= FEW_WAYS:
        ways = F.broadcast(ways)
    texts = documents.select("__id1", F.col(f"`{text}`").alias("t")).join(ways, F.col("__id1") == F.col("id1")).select("id1", "t", "node", "ways")
    kind = pairs.schema["p"].dataType.simpleString()

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows equal in id and text: one stands for all of a task
        for b in pieces(batches, 128):
            ids = b.column(0).to_pylist()
            new = [i for i, x in enumerate(ids) if not (x in seen or seen.add(x))]
            if not new:
                continue
            b = b.take(pa.array(new))
            at = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy(zero_copy_only=False))
            way = b.column(3).flatten()
            texts = [t.encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            size = pa.array([len(t) for t in texts], pa.int32()).take(pa.array(at))
            packed = pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary()).take(pa.array(at))
            x = b.column(2).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([way.field(0), way.field(1), way.field(2), x, size, packed], ["p", "lane", "member", "x", "size", "packed"])

    together = texts.mapInArrow(ship, f"p {kind}, lane int, member boolean, x {kind}, size int, packed binary").repartition(parts, "p", "lane").sortWithinPartitions("p", "lane", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for b in pieces(batches, 128):
            keep = []
            own = shingles([pa.decompress(t.as_buffer(), n, codec="zstd", asbytes=True).decode() for t, n in zip(b.column(5), b.column(4).to_pylist(), strict=True)], width)
            for member, t in zip(b.column(2).to_pylist(), own, strict=True):
                if not member:
                    pivot = t
                keep.append(member and linked(len(np.intersect1d(pivot, t, assume_unique=True)), len(pivot), len(t), percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], ["p", "x"]).filter(pa.array(keep, pa.bool_()))

    return together.mapInArrow(run, f"p {kind}, x {kind}")


def _index(rows: DataFrame) -> DataFrame:
    """token, g, n, pos of the groups' prefixes, for tokens that may stand in two rows. Those that stand in one never leave their task."""
    tokens = rows.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    tokens = written(tokens)
    shared = rows.sparkSession.sparkContext.broadcast((lambda f: (f.words, f.bits))(bloom(tokens, "token", tokens.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = cached(shared, lambda x: Bloom(*x))
        for b in pieces(batches):
            token = b.column(2).flatten()
            size = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(b.num_rows), size)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            some = np.flatnonzero(may.has(token.to_numpy(zero_copy_only=False).view(np.uint64)))
            of = pa.array(at[some])
            yield pa.RecordBatch.from_arrays([token.take(pa.array(some)), b.column(0).take(of), b.column(1).take(of), pa.array(pos[some], pa.int32())], ["token", "g", "n", "pos"])

    return rows.select("g", "n", "prefix").mapInArrow(run, "token bigint, g bigint, n bigint, pos int").groupBy("token", "g", "n").agg(F.min("pos").alias("pos"))


def _allowed(a: str, b: str, percent: int) -> str:
    """Whether groups a and b, which meet at a shingle of their prefixes, may link by their sizes and what stands behind the shingle."""
    return (f"100 * {a}n >= {percent} * {b}n and 100 * {b}n >= {percent} * {a}n and "
            f"{100 + percent} * (1 + least({a}n - {a}pos - 1, {b}n - {b}pos - 1)) >= {percent} * ({a}n + {b}n)")


def components_of(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id of each row; component_id is the smallest key of the rows that links reach."""
    picked = documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__t"))
    picked = picked.withColumn("__id1", F.xxhash64("__key", F.lit(13), "__t"))
    rare = rarity(picked, "__t", width)
    wide = written(prefixes(picked, "__t", ["__key", "__id1"], rare, width, percent))
    rows = written(wide.drop("prefix"))
    full = rows.filter("n > 0")
    node = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("least"), F.col("c").alias("c"))
    classes = full.groupBy("c").agg(F.min("__key").alias("least"), F.min("__id1").alias("id1"), F.min("n").alias("n"), F.min("g").alias("g"), F.count("*").alias("copies"))
    classes = written(classes.select(node.alias("node"), "c", "id1", "n", "g", "copies"))
    groups = written(classes.groupBy("g", "n").agg(F.min("node").alias("rep"), F.count("*").alias("members")))

    # the index: entries of shingles at which two groups meet
    entries = _index(wide.filter("n > 0")).withColumn("place", F.expr("shiftleft(cast(least(pos, 4095) as bigint), 51) | shiftrightunsigned(g, 13)"))
    entries = written(entries)
    met = written(entries.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"))
    total = met.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    index = written(spread_join(entries, met.select("token"), "token", hot_keys(met, "token", "m", total)).select("token", "g", "n", "pos", "place"))
    for done in (wide, entries):  # the largest tables; nothing that follows reads them
        dropped(done)

    def verified(pairs: DataFrame) -> DataFrame:
        return written(_verify(picked, "__t", classes, written(pairs), width, percent).select(F.col("p").alias("a"), F.col("x").alias("b")))

    # each group with that of a shingle which has the fewest rarer ones before it, and members of a group with its first one
    ends = met.select("token").join(index.groupBy("token").agg(F.min("place").alias("one"), F.count("*").alias("m")), "token")
    ends = written(ends)
    hot = hot_keys(ends, "token", "m", total)
    meet = spread_join(index, ends.select("token", "one"), "token", hot)
    pivot = meet.filter("place = one").groupBy("token").agg(F.min(F.struct("g", "n", "pos")).alias("p"))
    pairs = spread_join(meet, pivot, "token", hot).select("g", "n", "pos", F.col("p.g").alias("pg"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
    pairs = pairs.filter("g <> pg or n <> pn").filter(_allowed("", "p", percent)).select("g", "n", "pg", "pn").distinct()
    reps = groups.select("g", "n", "rep")
    pairs = pairs.join(reps, ["g", "n"]).withColumnRenamed("rep", "x").join(reps.select(F.col("g").alias("pg"), F.col("n").alias("pn"), F.col("rep").alias("p")), ["pg", "pn"]).select("p", "x")
    links = verified(pairs.unionByName(classes.join(groups.filter("members > 1"), ["g", "n"]).filter("node <> rep").select(F.col("rep").alias("p"), F.col("node").alias("x"))))
    # classes that link with one pivot, and the pivot, need no further trial among themselves
    star = links.groupBy("b").agg(F.min("a").alias("root")).unionByName(links.select(F.col("a").alias("b"), F.col("a").alias("root"))).groupBy("b").agg(F.min("root").alias("root"))
    label = written(classes.select("node", "g", "n").join(star, F.col("node") == F.col("b"), "left").select("node", "g", "n", F.coalesce("root", "node").alias("root")))

    # what is left: pairs of classes in different components whose groups meet, or that are of one group
    of = written(label.groupBy("g", "n").agg(F.min("root").alias("lo"), F.max("root").alias("hi")))
    here = index.join(of, ["g", "n"])
    ends = here.groupBy("token").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count("*").alias("m")).filter("least <> most")
    ends = written(ends)
    # lab: the one component of a group, if it has one
    lab = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    here = written(spread_join(here, ends.select("token"), "token", hot_keys(ends, "token", "m", total)).select("token", "g", "n", "pos", lab.alias("lab")))
    other = here.select("token", *(F.col(c).alias(f"o{c}") for c in ("g", "n", "pos", "lab")))
    apart = F.coalesce(F.col("lab") != F.col("olab"), F.lit(True)) & (F.struct("g", "n") < F.struct("og", "on"))
    meet = written(here.join(other, "token").filter(apart).filter(_allowed("", "o", percent)).select("g", "n", "og", "on").distinct())
    left = label.select("g", "n", F.col("node").alias("x"), F.col("root").alias("xr"))
    right = label.select(F.col("g").alias("og"), F.col("n").alias("on"), F.col("node").alias("p"), F.col("root").alias("pr"))
    rest = meet.join(left, ["g", "n"]).join(right, ["og", "on"]).filter("xr <> pr").select("p", "x")
    inside = left.join(of.filter("lo <> hi").select("g", "n"), ["g", "n"])  # members of one group in different components
    inside = inside.join(right, (F.col("g") == F.col("og")) & (F.col("n") == F.col("on"))).filter("x < p and xr <> pr").select("p", "x")
    rest = written(rest.unionByName(inside))
    if rest.limit(1).count():  # the end with more pairs is the pivot
        degree = rest.select(F.explode(F.array("p", "x")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
        turned = rest.join(degree.select(F.col("v").alias("p"), F.col("d").alias("dp")), "p").join(degree.select(F.col("v").alias("x"), F.col("d").alias("dx")), "x")
        turn = F.col("dx") > F.col("dp")
        links = links.unionByName(verified(turned.select(F.when(turn, F.col("x")).otherwise(F.col("p")).alias("p"), F.when(turn, F.col("p")).otherwise(F.col("x")).alias("x"))))

    roots = components(links).select(F.col("node").alias("b"), "root")
    label = classes.select("node").join(roots, F.col("node") == F.col("b"), "left").select("node", F.coalesce("root", "node").alias("root"))
    named = classes.select("c", "copies", F.col("node").alias("v")).join(label.select(F.col("node").alias("v"), "root"), "v").select("c", "copies", F.col("root.least").alias("least"))
    named = written(named)
    out = spread_join(full.select("__key", "n", "c"), named.drop("copies"), "c", hot_keys(named, "c", "copies", full.count()))
    out = out.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.unionByName(rows.filter("n = 0").select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), F.col("__key").alias("component_id")))
