"""Collocations: phrases of 2 and 3 words that stand together more often than their parts tell, by language.

Candidates are found level by level, as a phrase that is frequent has only frequent parts: tasks count the hashes of words, then
of pairs whose words are frequent, then of triples whose pairs are; counts are added before and after one shuffle a level, and what reaches the least count
is a candidate. The candidates below a level come to the tasks as a Bloom filter of bounded size, which may let more through, never fewer.

Then the candidates of all levels get slots of a minimal perfect hash (bit arrays in levels, ranked by popcount), and the key of a slot is stored
beside it, so that what isn't a candidate is told. One pass over the texts counts by slot: each task has one array, filled with
bincount; the arrays are added up in a tree; and the counts of a phrase's parts are read by their slots. This takes SLOTS candidates, whose
broadcast is 22 MB; if there are more, tasks send their counts of what passes a Bloom filter of the candidates, which are added by phrase in a
shuffle, and parts are found by joins. Results are equal.

The text of a slot is sent by one of the tasks that meet it, not by all of them: the levels note for each key in which lanes (tasks by their number) it
stood, at no cost in the shuffle, as a task has one lane. Should tasks have other rows in the last pass, what is left without a name is looked for once more.

A slot is told by 64 bits. Tasks also add up a second hash, from other hashes of the words, over all that they count; it must come to that of the named
texts times their counts. So two phrases of one hash are noticed; then all is done again with
another seed. A null or empty text has no words, a null language is "und", repeated rows count as often as they stand. Columns other than the named ones are
not read. Text is cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs; phrases don't cross pieces. A-Z
are lower-cased, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import COUNTERS, LOWER_BYTES, Bloom, bloom, cached, counters, distinct, mixed, pieces, tree_sum, word_hashes, written

LEAST, LONGEST, TOP, COVER_PERCENT = 10, 3, 2000, 50
#: Candidates that are counted by slots.
SLOTS = 1 << 21
#: Texts that a task reads together. Spark adds up the counts of a task before it shuffles them.
ROWS = 64
#: Lanes of tasks, bits of a mask. A slot is named by the tasks of one lane: of ANY, by each that meets it; of NONE, by none.
LANES, ANY, NONE = 62, 62, 63
_CUT = b"\xff"  # in no UTF-8 text
_TABLE = bytes(255 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c in b"\x09\x20" else c for c in LOWER_BYTES)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Slots:
    """A minimal perfect hash of distinct 64-bit keys, with the key of each slot, and the lane that names it."""

    def __init__(self, keys: np.ndarray, lanes: np.ndarray | None = None) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, taken = keys, 0
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            before = taken + np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            self.levels.append((size, words, before[:-1]))
            taken = int(before[-1])
            rest = rest[~alone[at]]
        self.keys, self.lanes = np.zeros(taken, np.uint64), np.full(taken, ANY, np.uint8)
        at = self._find(keys)
        self.keys[at] = keys
        if lanes is not None:
            self.lanes[at] = lanes

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level * int(_STEP)) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key of the set; any or none (-1) for others."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, (size, words, before) in enumerate(self.levels):
            at = self._place(keys[left], i, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) != 0
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = before[at[here] >> 6] + np.bitwise_count(below[here])
            left = left[~here]
            if not len(left):
                break
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't in the set."""
        at = self._find(keys)
        if not len(self.keys):
            return at
        at[self.keys[at] != keys] = -1
        return at


def _joined(h: np.ndarray, lang: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on, and of their language."""
    x = lang[at] + np.uint64(k)
    for j in range(k):
        x = (x ^ (x >> np.uint64(29))) * _STEP + h[at + j]
    return mixed(x)


class Read:
    """The words of some texts, one after the other: hashes, which are ends of pieces, and the language of each."""

    def __init__(self, texts: list[str | None], langs: list[str | None], seed: int) -> None:
        self.words: list[bytes] = []
        sizes = []
        for t in texts:
            before = len(self.words)
            if t:
                self.words += t.encode("utf-8", "replace").translate(_TABLE).replace(_CUT, b" \xff ").split(b" ")
            self.words.append(_CUT)
            sizes.append(len(self.words) - before)
        self.seed = seed
        self.ids, at = distinct(self.words)
        full = np.flatnonzero(at != self.ids.get(b"", -1))  # two spaces make an empty word
        self.place = full
        self.at = at[full]
        self.h = word_hashes(self.ids, seed)[self.at]
        self.cut = self.at == self.ids.get(_CUT, -1)
        self.langs = ["und" if x is None else x for x in langs]
        self.row = np.repeat(np.arange(len(texts)), sizes)[full]
        self.lang = self._lang(seed)

    def _lang(self, seed: int) -> np.ndarray:
        of = {x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"), seed=seed) for x in set(self.langs)}
        return np.array([of[x] for x in self.langs], np.uint64)[self.row] if self.langs else np.zeros(0, np.uint64)

    def second(self) -> tuple[np.ndarray, np.ndarray]:
        """Other hashes of the words and their languages."""
        seed = self.seed + (1 << 32)
        return word_hashes(self.ids, seed)[self.at], self._lang(seed)

    def starts(self, k: int) -> np.ndarray:
        """Where k words of one piece start."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(~reduce(np.logical_or, [self.cut[j : j + n] for j in range(k)]))

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        return _joined(self.h, self.lang, at, k)

    def phrases(self, at: np.ndarray, k: int) -> tuple[list[str], list[str]]:
        """Language and text of the k words from each place on."""
        words, langs = self.words, self.langs
        columns = [[words[p] for p in self.place[at + j].tolist()] for j in range(k)]
        return [langs[r] for r in self.row[at].tolist()], [b" ".join(w).decode("utf-8", "replace") for w in zip(*columns, strict=True)]

    def totals(self) -> dict[str, int]:
        n = np.bincount(self.row[~self.cut], minlength=len(self.langs))
        out: dict[str, int] = {}
        for x, c in zip(self.langs, n.tolist(), strict=True):
            out[x] = out.get(x, 0) + c
        return out


def _inner(has: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Those of starts (k words) at which and behind which a part of k - 1 words is frequent; has says of places whether theirs is."""
    flag = np.zeros((int(at[-1]) if len(at) else 0) + 2, bool)
    flag[at[has]] = True
    return starts[flag[np.minimum(starts, len(flag) - 1)] & flag[np.minimum(starts + 1, len(flag) - 1)]]


def _texts(documents: DataFrame, text: str, lang: str) -> DataFrame:
    return documents.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))


def _level(texts: DataFrame, k: int, below: Bloom | None, least: int, seed: int) -> DataFrame:
    """key, n, lane: the hashes of k words that reach the least count, and a lane of tasks in which each stands."""
    shared = texts.sparkSession.sparkContext.broadcast((below.words, below.bits)) if below is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, ROWS):
            read = Read(b.column(0).to_pylist(), b.column(1).to_pylist(), seed)
            at = read.starts(k)
            if shared is not None:
                parts = read.starts(k - 1)
                at = _inner(cached(shared, lambda x: Bloom(*x)).has(read.keys(parts, k - 1)), parts, at)
            key, n = np.unique(read.keys(at, k), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    # The mask is the same for all that a task sends, so it takes no room there once compressed.
    lane = F.expr(f"shiftleft(1L, cast(pmod(spark_partition_id(), {LANES}) as int))")
    counted = texts.mapInArrow(run, "key bigint, n bigint").withColumn("lanes", lane).groupBy("key").agg(F.sum("n").alias("n"), F.bit_or("lanes").alias("lanes")).filter(F.col("n") >= least)
    # The first of its lanes from one on that the key chooses, so that these names are spread over the lanes.
    chosen = f"cast(pmod(key, {LANES}) as int)"
    some = f"coalesce(nullif(shiftleft(shiftright(lanes, {chosen}), {chosen}), 0L), lanes)"
    return written(counted.withColumn("some", F.expr(some)).select("key", "n", F.expr("cast(bit_count(some ^ (some - 1)) - 1 as int)").alias("lane")))


def _by_slots(texts: DataFrame, slots: Slots, seed: int) -> tuple[np.ndarray, DataFrame, DataFrame] | None:
    """The count of each slot; slot, l, phrase of each that occurs; and the words of each language. None if two phrases have one hash."""
    rows = _read_slots(texts, slots, seed)
    total = tree_sum(rows.filter("chunk is not null").select("chunk", "places", "counts"), len(slots.keys))
    words = rows.filter("slot = -1").groupBy(F.col("l").alias("lang")).agg(F.sum("second").alias("n"))
    named = _names(rows)
    if named.count() < (occur := np.count_nonzero(total)):
        rest = Slots(slots.keys[:0])
        rest.levels, rest.keys, rest.lanes = slots.levels, slots.keys, np.full(len(total), ANY, np.uint8)
        rest.lanes[named.select("slot").toArrow().column("slot").to_numpy()] = NONE  # SLOTS numbers at most
        named = _names(rows.unionByName(_read_slots(texts, rest, seed).filter("slot >= 0")))
    told = rows.filter("slot = -2").agg(F.sum(F.col("second").cast("decimal(38,0)"))).first()[0]
    if named.count() != occur or (int(told or 0) - _told(named, total)) % (1 << 64):
        return None
    return total, named, words


def _names(rows: DataFrame) -> DataFrame:
    """slot, l, phrase, second: lanes of several tasks have sent some more than once."""
    return written(rows.filter("slot >= 0").groupBy("slot", "l", "phrase").agg(F.first("second").alias("second")))


def _told(named: DataFrame, total: np.ndarray) -> int:
    """The second hashes of what is named times their counts, all together (their lower 64 bits)."""
    shared = named.sparkSession.sparkContext.broadcast(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sum(int((shared.value[b.column(0).to_numpy()].view(np.uint64) * b.column(1).to_numpy().view(np.uint64)).sum(dtype=np.uint64)) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.array([own % (1 << 64)], np.uint64).view(np.int64))], ["told"])

    return int(named.select("slot", "second").mapInArrow(run, "told bigint").agg(F.sum(F.col("told").cast("decimal(38,0)"))).first()[0] or 0)


def _read_slots(texts: DataFrame, slots: Slots, seed: int) -> DataFrame:
    """Counters of slots by task; l, phrase and second hash of each slot from tasks of its lane; words by language (slot -1); all second hashes (-2)."""
    shared = texts.sparkSession.sparkContext.broadcast(slots)
    size = len(slots.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        total = np.zeros(size, np.int64)
        unnamed = (slots.lanes == TaskContext.get().partitionId() % LANES) | (slots.lanes == ANY)
        words: dict[str, int] = {}
        every = 0
        met: list[np.ndarray] = []  # slots that are not counted yet

        def named(slot: np.ndarray, langs: list[str | None], texts: list[str | None], second: np.ndarray) -> pa.RecordBatch:
            n = len(slot)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(slot, pa.int32()), pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(second.view(np.int64))], names)

        names = ["chunk", "places", "counts", "slot", "l", "phrase", "second"]
        for b in pieces(batches, ROWS):
            if sum(map(len, met)) > SLOTS // 2:
                total += np.bincount(np.concatenate(met), minlength=size)
                met.clear()
            read = Read(b.column(0).to_pylist(), b.column(1).to_pylist(), seed)
            for x, n in read.totals().items():
                words[x] = words.get(x, 0) + n
            second = read.second()
            before: tuple[np.ndarray, np.ndarray] | None = None
            for k in range(1, LONGEST + 1):
                at = read.starts(k)
                if before is not None:
                    at = _inner(before[1] >= 0, before[0], at)
                slot = slots.of(read.keys(at, k))
                before = at, slot
                at, slot = at[slot >= 0], slot[slot >= 0]
                met.append(slot.astype(np.int32))
                told = _joined(*second, at, k)
                every = (every + int(told.sum(dtype=np.uint64))) % (1 << 64)
                new = np.flatnonzero(unnamed[slot])
                one, first = np.unique(slot[new], return_index=True)
                unnamed[one] = False
                if len(one):
                    yield named(one, *read.phrases(at[new[first]], k), told[new[first]])
        if met:
            total += np.bincount(np.concatenate(met), minlength=size)
        yield named(np.full(len(words), -1), list(words), [None] * len(words), np.array(list(words.values()), np.int64))
        yield named(np.array([-2]), [None], [None], np.array([every], np.uint64))
        got = counters(total)
        n = got.num_rows
        yield pa.RecordBatch.from_arrays([*got.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names)

    return written(texts.mapInArrow(run, f"{COUNTERS}, slot int, l string, phrase string, second bigint"))


_PARTS = "l string, phrase string, k int, a bigint, l1 bigint, r1 bigint, l2 bigint, r2 bigint"


def _cuts(total: np.ndarray, named: DataFrame, slots: Slots, least: int, seed: int) -> DataFrame:
    """The frequent phrases of two words and more with the counts of their parts, read by slot."""
    shared = named.sparkSession.sparkContext.broadcast((slots, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, total = shared.value

        def read(phrases: list[str], langs: list[str], k: int) -> np.ndarray:
            own = Read([], [], seed)
            ids, places = distinct([w for p in phrases for w in p.encode().split(b" ")])
            own.h = word_hashes(ids, seed)[places]
            of = {x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"), seed=seed) for x in set(langs)}
            own.lang = np.repeat(np.array([of[x] for x in langs], np.uint64), k)
            return own

        for b in pieces(batches, 1 << 14):
            slot, langs, phrases = (b.column(i).to_pylist() for i in range(3))
            a = total[np.array(slot, np.int64)]
            size = np.array([p.count(" ") + 1 for p in phrases])
            for k in range(2, LONGEST + 1):
                some = np.flatnonzero((size == k) & (a >= least))
                if not len(some):
                    continue
                texts, of = [phrases[i] for i in some], [langs[i] for i in some]
                own, at = read(texts, of, k), np.arange(len(some)) * k
                part = [(total[slots.of(own.keys(at, j))], total[slots.of(own.keys(at + j, k - j))]) for j in range(1, k)]
                none = pa.nulls(len(some), pa.int64())
                sides = [pa.array(x) for pair in part for x in pair] + [none] * (2 * (LONGEST - k))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(texts, pa.string()), pa.array(np.full(len(some), k), pa.int32()), pa.array(a[some]), *sides], ["l", "phrase", "k", "a", "l1", "r1", "l2", "r2"])

    return named.select("slot", "l", "phrase").mapInArrow(run, _PARTS)


def _by_shuffle(texts: DataFrame, wanted: Bloom, least: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """As _cuts, and the words of each language, for any number of candidates: counts are added by phrase, parts are joined."""
    shared = texts.sparkSession.sparkContext.broadcast((wanted.words, wanted.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = cached(shared, lambda x: Bloom(*x))
        for b in pieces(batches, ROWS):
            read = Read(b.column(0).to_pylist(), b.column(1).to_pylist(), seed)
            counts = {(x, "", 0): n for x, n in read.totals().items()}  # no words, for those of the language
            for k in range(1, LONGEST + 1):
                at = read.starts(k)
                for own in zip(*read.phrases(at[may.has(read.keys(at, k))], k), repeat(k)):
                    counts[own] = counts.get(own, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in counts], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))] + [pa.array(list(counts.values()), pa.int64())], ["l", "phrase", "k", "a"])

    every = written(texts.mapInArrow(run, "l string, phrase string, k int, a bigint").groupBy("l", "phrase", "k").agg(F.sum("a").alias("a")).filter((F.col("a") >= least) | (F.col("k") == 0)))
    words = F.split("phrase", " ")
    out = every.filter("k > 1")
    for j in (1, 2):
        for side, start, n in (("l", 1, F.lit(j)), ("r", j + 1, F.col("k") - j)):
            part = F.when(F.col("k") > j, F.array_join(F.slice(words, F.lit(start), F.greatest(n, F.lit(0))), " "))
            own = every.select(F.col("l").alias("__l"), F.col("phrase").alias("__p"), F.col("a").alias(f"{side}{j}"))
            out = out.withColumn("__part", part).join(own, (F.col("l") == F.col("__l")) & (F.col("__part") == F.col("__p")), "left").drop("__part", "__l", "__p")
    return out.select("l", "phrase", "k", "a", "l1", "r1", "l2", "r2"), every.filter("k = 0").select(F.col("l").alias("lang"), F.col("a").alias("n"))


def _scored(rows: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score: that of the cut that scores least. Whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, *sides = (b.column(i).to_pylist() for i in range(3, 8))
            best = []
            for n, l1, r1, l2, r2 in zip(a, *sides, strict=True):
                cuts = [(1_000_000 * n * n // (p * q), j, p, q) for j, (p, q) in enumerate(((l1, r1), (l2, r2))) if p is not None]
                best.append(min(cuts))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array([c[i] for c in best], pa.int64()) for i in (2, 3, 0))], ["lang", "phrase", "k", "a", "l", "r", "score"])

    return rows.mapInArrow(run, "lang string, phrase string, k int, a bigint, l bigint, r bigint, score bigint")


def phrases(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, slots: int = SLOTS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """All candidates (lang, phrase, k, a, l, r, score), and lang, n: the words of each language."""
    texts = _texts(documents, text, lang)
    levels: list[DataFrame] = []
    for k in range(1, LONGEST + 1):
        below = levels[-1] if levels else None
        levels.append(_level(texts, k, bloom(below, "key", below.count()) if below is not None else None, least, seed))
    keys = reduce(DataFrame.unionByName, [x.select("key", "lane") for x in levels]).groupBy("key").agg(F.min("lane").alias("lane"))
    n = keys.count()
    if n > slots:
        cuts, totals = _by_shuffle(texts, bloom(keys, "key", n), least, seed)
        return written(_scored(cuts)), totals
    got = keys.toArrow()  # SLOTS rows at most
    own = Slots(got.column("key").to_numpy().view(np.uint64), got.column("lane").to_numpy())
    found = _by_slots(texts, own, seed)
    if found is None:
        return phrases(documents, text, lang, least, slots, seed + 1)
    count, named, totals = found
    return written(_scored(_cuts(count, named, own, least, seed))), totals


def mine(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, cover_percent: int = COVER_PERCENT, slots: int = SLOTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language, without those that longer ones cover."""
    found, totals = phrases(documents, text, lang, least, slots)
    longer = found.filter(f"k = {LONGEST}").select("lang", "a", F.split("phrase", " ").alias("w"))
    inside = longer.select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"))
    cover = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = found.join(cover, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < cover_percent * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # Spark ranks in each task before it shuffles
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
