"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word bytes after ASCII lower-casing: 0-9, a-z and everything beyond ASCII; the rest separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: ASCII lower-casing alone. bytes.split() then cuts at 0x20 and 0x09-0x0D.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that a function on texts looks at together. Spark bounds the bytes of a batch (maxBytesPerBatch), not what a function makes of it.
ROWS_AT_ONCE = 512


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, a bounded number at a time, whatever the session's batch size is."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def cached(shared, build: Callable):
    """build(shared.value), made once in each worker process: a broadcast stays there from task to task."""
    if getattr(shared, "_built", None) is None:
        shared._built = build(shared.value)
    return shared._built


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="busloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: The checkpoints and tables of the run that is on in this thread, if it keeps account of them.
_RUN: ContextVar[list[str] | None] = ContextVar("busloom_run", default=None)


@contextmanager
def own_files(spark: SparkSession) -> Iterator[None]:
    """Checkpoints and tables made inside go at its end, or when it fails. Those of other runs stay, in whatever thread they are.

    For a caller that has written all results that hang on them by then.
    """
    made: list[str] = []
    before = _RUN.set(made)
    try:
        yield
    finally:
        _RUN.reset(before)
        for path in reversed(made):
            remove(spark, path)


def _note(path: str) -> None:
    if (made := _RUN.get()) is not None:
        made.append(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder: a lost executor loses none of them."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    file = out._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        _note(file.get())
    return out


def written(df: DataFrame) -> DataFrame:
    """The same rows, without order, from a compressed table in the shared folder: for wide rows, of which a step needs few columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove a table of written() before its run ends: for large ones on which no later step or result hangs."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def hot_keys(counted: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """key (as __hot) of the keys that hold over a share-th of total rows: fewer than share of them, whatever the table's size."""
    return counted.filter(F.col(n) > max(100, total // share)).select(F.col(key).alias("__hot"))


def spread_join(rows: DataFrame, own: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined by key with own, which has each key once. Rows of the few hot keys stay where they are, and own's come to them."""
    few = F.broadcast(hot)  # under a thousand keys, see hot_keys
    on = F.col(key) == F.col("__hot")
    theirs = F.broadcast(own.join(few, on, "left_semi"))
    return rows.join(few, on, "left_anti").join(own, key).unionByName(rows.join(theirs, key))


def smallest(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The n rows with the smallest hash of a key, of total rows.

    A threshold on the hash lets through about 2 n rows before they are sorted: else each task would send n rows.
    """
    hashed = df.withColumn("__h", F.xxhash64(key))
    if total > 3 * n >= 1000:
        hashed = hashed.filter(F.col("__h") < int(-(1 << 63) + (1 << 64) * 2 * n / total))
    return hashed.orderBy("__h", key).limit(n).drop("__h")


def map_texts(df: DataFrame, keys: Sequence[str], text: str, make: Callable[[], Callable[[list], list]], columns: str) -> DataFrame:
    """Apply a per-batch text function on the executors, in Arrow batches.

    make() runs once in each task and returns the function; that gets the texts (None for null) and returns one list or
    Arrow array for each of the columns (a DDL string). Only keys and text are read, so further columns never clash.
    """
    picked = df.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`").cast("string").alias("__text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        names = None
        for batch in pieces(batches):
            out = [x if isinstance(x, pa.Array) else pa.array(x) for x in apply(batch.column(n).to_pylist())]
            names = names or [*batch.schema.names[:n], *(f"c{i}" for i in range(len(out)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *out], names)

    out = picked.mapInArrow(_named(run, columns, n), f"{shape}, {columns}" if keys else columns)
    return out


def _named(run: Callable, columns: str, n: int) -> Callable:
    """Give the batches of run the names and types of a DDL column list."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(columns))

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            own = [c if c.type == f.type else c.cast(f.type) for c, f in zip(b.columns[n:], wanted, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *own], [*b.schema.names[:n], *wanted.names])

    return renamed


def identities(key: str, text: str) -> list[Column]:
    """Two hashes that tell rows apart by key and text; rows equal in both may stand for each other."""
    return [F.xxhash64(F.col(key), F.lit(1), F.col(text)).alias("__id1"), F.xxhash64(F.col(text), F.lit(2), F.col(key)).alias("__id2")]


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], spread: Column, rows_per_bucket: int, amount: Column | None = None, nullable: bool = True, width: int = 64, ranges: Column | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Add start: the running total of amount (1 if none) within a group, before the row, in the order (ranges, spread, order).

    spread is an even hash of width bits (signed if 64). A group is cut into ranges of it, each small enough for one task, so no group is ever
    sorted in a single task: totals by range come first (pre-aggregated), their running totals second, and the rows of a
    range last. The number of ranges follows the number of rows. Ranges that are there already, such as the files of an ordered table, may be given instead.
    With nullable=False the group has no nulls, and its join needs no further shuffle. totals has the same rows as df without
    what only df needs, and is read for the totals in its place.
    """
    amount = F.lit(1).cast("long") if amount is None else amount
    if ranges is None:
        rows = (df if totals is None else totals).count()
        bits = max(0, min(30, (max(rows, 1) // rows_per_bucket).bit_length()))
        ranges = F.shiftright(spread, width - bits) if bits else F.lit(0).cast("long")
    cut = df.withColumns({"__spread": spread, "__amount": amount, "__range": ranges})
    summed = cut if totals is None else totals.withColumns({"__amount": amount, "__range": ranges})
    by = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = summed.groupBy(*group, "__range").agg(F.sum("__amount").alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(by), F.lit(0))).drop("__sum")
    starts = starts.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__range").alias("__r"), "__base")
    inner = Window.partitionBy(*group, "__range").orderBy("__spread", *order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        on = on & (F.col(g).eqNullSafe(F.col(f"__g{i}")) if nullable else F.col(g) == F.col(f"__g{i}"))
    out = cut.withColumn("__before", F.coalesce(F.sum("__amount").over(inner), F.lit(0))).join(starts, on)
    return out.withColumn("start", F.col("__base") + F.col("__before")).drop("__spread", "__amount", "__range", "__before", "__base", "__r", *(f"__g{i}" for i in range(len(group))))

#: Bits of a Bloom filter, at most: 32 MB. A set that fills it lets more through, none fewer.
BLOOM_BITS = 28
#: Counters of an array that tasks sum up, in one piece.
CHUNK = 1 << 16


class Bloom:
    """Which 64-bit hashes may be in a set. Two places a hash, from its upper and its middle bits."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        down = np.uint64(64 - self.bits)

        def at(place: np.ndarray) -> np.ndarray:
            return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0

        return at(h >> down) & at((h << np.uint64(28)) >> down)


def bloom(hashes: DataFrame, column: str, n: int) -> Bloom:
    """A filter for n even 64-bit hashes (signed longs), of 16 bits for each and of BLOOM_BITS in all, at most. Its words are put together in tasks."""
    bits = max(10, min(BLOOM_BITS, (16 * max(n, 1) - 1).bit_length()))
    places = hashes.select(F.explode(F.expr(f"array(shiftrightunsigned(`{column}`, {64 - bits}), shiftrightunsigned(shiftleft(`{column}`, 28), {64 - bits}))")).alias("p"))
    got = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return Bloom(words, bits)


def counters(total: np.ndarray) -> pa.RecordBatch:
    """Counters that a task has filled, as rows for tree_sum: only those above zero, where these are few."""
    rows = []
    for at in range(0, len(total), CHUNK):
        own = total[at : at + CHUNK]
        some = np.flatnonzero(own)
        if len(some):
            kind = np.min_scalar_type(int(own.max()))  # as many bytes as the largest needs
            few = (2 + kind.itemsize) * len(some) < kind.itemsize * len(own)
            rows.append((at // CHUNK, some.astype(np.uint16).tobytes() if few else b"", (own[some] if few else own).astype(kind).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["chunk", "places", "counts"])


COUNTERS = "chunk int, places binary, counts binary"


def _add(own: np.ndarray, places: bytes, counts: bytes) -> None:
    at = np.frombuffer(places, np.uint16)
    n = np.frombuffer(counts, f"u{len(counts) // (len(at) or len(own))}")
    if len(at):
        own[at] += n.astype(np.int64)
    else:
        own += n.astype(np.int64)


def tree_sum(rows: DataFrame, size: int, lanes: int = 16) -> np.ndarray:
    """The sum of the counters of all tasks (size of them, a bounded number): first within lanes, then over these."""

    if not size:
        return np.zeros(0, np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, places, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(chunk, np.zeros(min(CHUNK, size - chunk * CHUNK), np.int64))
                _add(own, places, counts)
        for chunk, own in sums.items():
            full = counters(own)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *full.columns[1:]], full.schema.names)

    parts = min(-(-size // CHUNK) * lanes, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lane = rows.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    first = lane.repartition(parts, "chunk", "lane").drop("lane").mapInArrow(add, COUNTERS)
    out = np.zeros(size, np.int64)
    for r in first.repartition(min(parts, -(-size // CHUNK)), "chunk").mapInArrow(add, COUNTERS).toLocalIterator():
        _add(out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK], bytes(r.places), bytes(r.counts))
    return out


def distinct(words: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """The distinct words with their numbers, and the number of each word of the list."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    return ids, np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def word_hashes(ids: dict[bytes, int], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each of the distinct words, by number."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ids, repeat(seed)), np.uint64, len(ids))


_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """Even 64-bit hashes from what may be uneven."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))
