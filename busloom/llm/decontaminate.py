"""Benchmark decontamination.

Items are cut into windows of 10 words, whose hashes form a set that every worker process gets by broadcast. A training text is
hashed into windows of the same lengths, those in the set are verified word by word, and hit words are marked. Documents
with hits can be dropped, or only the spans taken out.

Words are runs of 0-9, a-z and non-ASCII after lower-casing A-Z. A null or empty text has no words and no hits, and so has
an item; an empty benchmark hits nothing. Items with a null id mark words but are not counted or listed. Repeated items and
documents each count by their own rows. Columns other than the named ones are not read.

The broadcast holds the benchmark's words and is made only if their bytes are at most max_broadcast_bytes. For a larger
benchmark a Bloom filter of its window hashes is broadcast, of FILTER_BITS bits at most; windows of documents that pass it are
joined with those of the benchmark, by text. Windows that hold over a thousandth of what passes are joined where they stand. Results
are equal, and all functions here work either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, cached, checkpointed, hot_keys, map_texts, pieces, spread_join

MAX_BROADCAST_BYTES = 16 << 20
#: Size of the Bloom filter, at most: 32 MB. A benchmark that fills it lets more windows through, none fewer.
FILTER_BITS = 1 << 28
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEN_BITS = 22
_COLUMNS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, spans array<struct<first:int,last:int>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_NONE = hashlib.sha256(b"").hexdigest()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


class Windows:
    """The set of window hashes by length. Windows are kept as places in the items' words; equal ones are one window."""

    def __init__(self, items: list[tuple[object, str | None]], size: int) -> None:
        one: dict[bytes, bytes] = {}
        self.words = [[one.setdefault(w, w) for w in words_of(t)] for _, t in items]
        self.ids = [i for i, _ in items]
        sizes = [min(size, len(w)) for w in self.words]
        #: By length: a bitmap of the hashes' first bits, the hashes in order, and item and first word of each window.
        self.hashes: dict[int, tuple[np.ndarray, ...]] = {}
        for k in sorted(set(sizes) - {0}):
            own = [i for i, n in enumerate(sizes) if n == k]
            h = [rolling(np.array([hash(w) for w in self.words[i]], np.int64).view(np.uint64), k) for i in own]
            item = np.repeat(np.array(own, np.int32), [len(x) for x in h])
            first = np.concatenate([np.arange(len(x), dtype=np.int32) for x in h])
            h = np.concatenate(h)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _SEEN_BITS, dtype=bool)
            seen[h >> np.uint64(64 - _SEEN_BITS)] = True
            self.hashes[k] = (seen, h[order], item[order], first[order])

    def scan(self, texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        """For each text (its words): first word, end and place in the hashes of each window that occurs. One pass over all texts at once."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        total = int(ends[-1]) if len(ends) else 0
        if not self.hashes or not total:
            return out
        h = np.fromiter(map(hash, chain.from_iterable(texts)), dtype=np.int64, count=total).view(np.uint64)
        for k, (seen, wanted, item, first) in self.hashes.items():
            if total < k:
                continue
            r = rolling(h, k)
            at = np.flatnonzero(seen[r >> np.uint64(64 - _SEEN_BITS)])
            place = np.searchsorted(wanted, r[at])
            good = wanted[np.minimum(place, len(wanted) - 1)] == r[at]
            at, place = at[good], place[good]
            for i, doc, p in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist(), place.tolist(), strict=True):
                words = texts[doc]
                i -= int(ends[doc]) - len(words)
                mine = words[i : i + k]  # a window over the end of a text is shorter
                while self.words[item[p]][first[p] : first[p] + k] != mine:  # another window, of the same hash
                    p += 1
                    if p == len(wanted) or wanted[p] != wanted[p - 1]:
                        break
                else:
                    out[doc].append((i, i + k, p))
        return out

    def items(self, found: list[tuple[int, int, int]]) -> set:
        """The ids of the items with the windows found, null aside."""
        ids = set()
        for k, p in {(b - a, p) for a, b, p in found}:
            _, wanted, item, first = self.hashes[k]
            mine = self.words[item[p]][first[p] : first[p] + k]
            for q in range(p, int(np.searchsorted(wanted, wanted[p], "right"))):
                if q == p or self.words[item[q]][first[q] : first[q] + k] == mine:
                    ids.add(self.ids[item[q]])
        return ids - {None}


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each k consecutive word hashes, put together from those of 1, 2, 4 ... words."""
    power, out, size = h, None, 0
    factor, width = int(_BASE), 1
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                out = power if out is None else out[: len(out) - width] * np.uint64(factor) + power[size : size + len(out) - width]
                size += width
            if size == k:
                return out.copy() if out is h else out
            power = power[:-width] * np.uint64(factor) + power[width:]
            factor, width = factor * factor & 0xFFFFFFFFFFFFFFFF, 2 * width


def _merged(found: list[tuple[int, int, int]]) -> list[dict]:
    spans: list[list[int]] = []
    for a, b, _ in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [{"first": a, "last": b - 1} for a, b in spans]


def digest(ids: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest() if ids else _NONE


def scan(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, spans (of words, first and last) and contaminated, for each document."""
    items = benchmark.select(F.col(item).alias("i"), F.col(item_text).cast("string").alias("t"))
    shared = _shared(documents, items, max_broadcast_bytes)
    if shared is None:
        out = _scan_by_join(documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), items, size).withColumnRenamed("k", key)
    else:

        def make():
            windows = cached(shared, lambda items: Windows(items, size))

            def apply(texts: list) -> list:
                cols: list[list] = [[], [], [], [], []]
                split = [words_of(t) for t in texts]
                for words, found in zip(split, windows.scan(split), strict=True):
                    spans = _merged(found)
                    ids = windows.items(found)
                    for c, v in zip(cols, (len(words), sum(s["last"] - s["first"] + 1 for s in spans), len(ids), digest(ids), spans), strict=True):
                        c.append(v)
                return [*cols[:4], pa.array(cols[4], _SPANS)]

            return apply

        out = map_texts(documents, [key], text, make, _COLUMNS)
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _shared(documents: DataFrame, items: DataFrame, most: int):
    """The items (i, t) as a broadcast, or None if their texts have more than most bytes."""
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > most:
        return None
    return documents.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in items.collect()])  # most bytes of text, and ids


def _hashes(texts: list[list[bytes]]) -> np.ndarray:
    """Hashes of the words of some texts, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64)


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, n, h, g = [], [], [], []
            for at, t in enumerate(b.column(1).to_pylist()):
                words = words_of(t)
                k = min(size, len(words))
                if k:
                    r = rolling(_hashes([words]), k)
                    ids += [at] * len(r)
                    n += [k] * len(r)
                    h.append(r)
                    g += [b" ".join(words[p : p + k]).decode("utf-8", "replace") for p in range(len(r))]
            h = np.concatenate(h) if h else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int32()), pa.array(h.view(np.int64)), pa.array(g, pa.string())], ["i", "n", "h", "g"])

    return run


def _scan_by_join(documents: DataFrame, items: DataFrame, size: int, bits: int = FILTER_BITS) -> DataFrame:
    """The same for a benchmark of any size. Documents with equal id and text are matched once."""
    spark = documents.sparkSession
    kind = items.schema["i"].dataType.simpleString()
    wins = checkpointed(items.mapInArrow(_item_windows(size), f"i {kind}, n int, h bigint, g string").distinct())
    sizes = [r.n for r in wins.select("n").distinct().collect()]  # at most size lengths
    # a bitmap of 64-bit words, or-ed together before it is gathered: at most bits / 64 rows
    place = F.expr(f"h & {bits - 1}L")
    marks = wins.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[marks.column("w").to_numpy()] = marks.column("m").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast((sizes, bitmap))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bitmap = shared.value
        for b in pieces(batches):
            texts = [words_of(t) for t in b.column(2).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            hashes = _hashes(texts)
            row, first, length, g = [], [], [], []
            for k in sizes:
                if len(hashes) < k:
                    continue
                r = rolling(hashes, k) & np.uint64(bits - 1)
                at = np.flatnonzero(bitmap[r >> np.uint64(6)] >> (r & np.uint64(63)) & np.uint64(1))
                for i, doc in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist(), strict=True):
                    i -= int(ends[doc]) - len(texts[doc])
                    if i + k <= len(texts[doc]):
                        row.append(doc)
                        first.append(i)
                        length.append(k)
                        g.append(b" ".join(texts[doc][i : i + k]).decode("utf-8", "replace"))
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(first, pa.int32()), pa.array(length, pa.int32()), pa.array(g, pa.string())], ["k", "d", "p", "n", "g"])

    docs = documents.withColumn("d", F.sha2("t", 256))
    kind = documents.schema["k"].dataType.simpleString()
    once = docs.select("k", "d", "t").dropDuplicates(["k", "d"])
    hits = checkpointed(once.mapInArrow(passing, f"k {kind}, d string, p int, n int, g string"))
    hot = hot_keys(hits.groupBy("g").agg(F.count("*").alias("hits")), "g", "hits", hits.count())
    found = spread_join(hits, wins.groupBy("g").agg(F.collect_set("i").alias("ids")), "g", hot)  # words joined by spaces tell their number
    merged = F.expr("""aggregate(array_sort(s), cast(array() as array<struct<first:int,last:int>>), (a, x) ->
        if(size(a) > 0 and x.first <= element_at(a, -1).last + 1,
           concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))),
           concat(a, array(named_struct('first', x.first, 'last', x.last)))))""")
    per = found.groupBy("k", "d").agg(F.collect_list(F.struct(F.col("p").alias("first"), (F.col("p") + F.col("n") - 1).alias("last"))).alias("s"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    per = per.select(F.col("k").alias("k2"), F.col("d").alias("d2"), merged.alias("spans2"), F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",").alias("listed"), F.size("ids").cast("long").alias("items2"))
    out = map_texts(docs, ["k", "d"], "t", lambda: lambda texts: [[len(words_of(t)) for t in texts]], "n_words bigint")
    out = out.join(per, F.col("k").eqNullSafe(F.col("k2")) & F.col("d").eqNullSafe(F.col("d2")), "left")
    spans = F.coalesce(F.col("spans2"), F.array().cast("array<struct<first:int,last:int>>"))
    return out.select("k", "n_words", F.expr("aggregate(coalesce(spans2, array()), 0L, (a, x) -> a + x.last - x.first + 1)").alias("n_hit"), F.coalesce("items2", F.lit(0).cast("long")).alias("n_items"), F.coalesce(F.sha2(F.col("listed"), 256), F.lit(_NONE)).alias("items_sha256"), spans.alias("spans"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = 10, remove: str = "documents", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """documents without what the benchmark holds: remove 'documents' with a hit, or only the 'spans' of hit words.

    All columns stay. With a benchmark that can be broadcast, the decision is taken in the pass that reads the text; else
    texts with hits are joined by their digest, so repeated rows are treated alike either way. With 'spans' the words of a
    span and what stands between them go; other characters stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r}")
    items = benchmark.select(F.col("item_id").alias("i"), F.col("text").cast("string").alias("t"))
    shared = _shared(documents, items, max_broadcast_bytes)
    at = documents.columns.index(text)
    if shared is None:
        own = documents.withColumn("__d", F.sha2(F.col(f"`{text}`").cast("string"), 256))
        texts = own.select("__d", F.col(f"`{text}`").cast("string").alias("t")).dropDuplicates(["__d"])
        seen = _scan_by_join(texts.select(F.col("__d").alias("k"), "t"), items, size).filter("n_hit > 0").select(F.col("k").alias("__e"), F.col("spans").alias("__s"))
        if remove == "documents":
            return own.join(seen, F.col("__d") == F.col("__e"), "left_anti").drop("__d")
        hot = hot_keys(own.groupBy("__d").agg(F.count("*").alias("n")).filter("__d is not null"), "__d", "n", documents.count())
        seen = own.select("__d").filter("__d is not null").distinct().join(seen, F.col("__d") == F.col("__e"), "left").drop("__e")
        marked = spread_join(own.filter("__d is not null"), seen, "__d", hot).unionByName(own.filter("__d is null").withColumn("__s", F.lit(None).cast("array<struct<first:int,last:int>>")))
        marked = marked.select(*(F.col(f"`{c}`") for c in documents.columns), "__s")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                texts = [cut_spans(t, s) if s else t for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if i == at else c for i, c in enumerate(b.columns[:-1])], schema=b.schema.remove(b.num_columns - 1))

        return marked.mapInArrow(cut, documents.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = cached(shared, lambda items: Windows(items, size))
        for b in pieces(batches):
            texts = b.column(at).to_pylist()
            found = windows.scan([words_of(t) for t in texts])
            if remove == "documents":
                yield b.filter(pa.array([not f for f in found], pa.bool_()))
            else:
                kept = pa.array([cut_spans(t, _merged(f)) if f else t for t, f in zip(texts, found, strict=True)], b.column(at).type)
                yield pa.RecordBatch.from_arrays([kept if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return documents.mapInArrow(run, documents.schema)


def cut_spans(text: str, spans: list[dict]) -> str:
    """text without the words from first to last of each span."""
    raw = text.encode("utf-8")
    plain = raw.translate(WORD_BYTES)
    starts, ends, i = [], [], 0
    for w in plain.split():
        i = plain.index(w, i)
        starts.append(i)
        i += len(w)
        ends.append(i)
    out, last = [], 0
    for s in spans:
        out.append(raw[last : starts[s["first"]]])
        last = ends[s["last"]]
    return b"".join([*out, raw[last:]]).decode("utf-8")
