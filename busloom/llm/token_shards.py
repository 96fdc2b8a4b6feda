"""Token ids in training order, as fixed-stride binary records.

Documents are tokenised and cut into sequences of LENGTH tokens; the last one of a document ends with the end token and is
padded. Sequences are numbered without gaps in the order of a hash of the document's key and text, and a keyed Feistel permutation
with cycle-walking maps each number to its slot in training order: a bijection of [0, n) that needs no shuffle buffer and can be
inverted. Records are range-partitioned by slot and written as shards of RECORDS records of equal size, so that slot s stands in
shard s // RECORDS at byte (s % RECORDS) * stride and a reader can resume anywhere.

The hash alone gives the order, so the same rows and seed make the same bytes, however the input is split and wherever tasks run.

A record is a little-endian uint32 count of tokens, then LENGTH ids as uint16 (uint32 for vocabularies over 65,535); in a file
a line feed follows, which is part of the stride. A null or empty text makes one sequence with the end token alone. Special strings
in a text are ordinary text. Repeated rows make sequences of their own; which of them comes first is of no effect, as they are
equal. An empty table makes no record. Columns other than key and text are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import identities, map_texts, pieces, remove, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this kind cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH, RECORDS, END = 1024, 4096, 50256
#: Bytes of a vocabulary file that may be broadcast.
MAX_VOCABULARY = 16 << 20
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed bijection of [0, n)."""

    def __init__(self, n: int, key: int, rounds: int = 6) -> None:
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & _MASK) for r in range(rounds)]

    def _rounds(self, x: np.ndarray, keys: list, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (_mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & self.mask)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        with np.errstate(over="ignore"):
            out = self._rounds(np.asarray(x).astype(np.uint64), keys, back)
            while (far := np.flatnonzero(out >= np.uint64(self.n))).size:
                out[far] = self._rounds(out[far], keys, back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def vocabulary(path: str) -> dict[bytes, int]:
    raw = Path(path).read_bytes()
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"{path}: over {MAX_VOCABULARY} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def stride_of(length: int = LENGTH, end: int = END) -> int:
    """Bytes from one record of a shard to the next: count, ids and a line feed."""
    return 4 + (2 if end < 1 << 16 else 4) * length + 1


def sequences(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """key, two hashes of key and text, ids (all tokens of a document, binary) and n_seqs of each row."""
    ranks = documents.sparkSession.sparkContext.broadcast(vocabulary(path))  # at most MAX_VOCABULARY bytes
    kind = "<u2" if end < 1 << 16 else "<u4"

    def make():
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})

        def apply(texts: list) -> list:
            ids = [np.array([*coder.encode_ordinary(t or ""), end], dtype=kind) for t in texts]
            return [[i.tobytes() for i in ids], [-(-len(i) // length) for i in ids]]

        return apply

    marked = documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    marked = marked.select("*", *identities("__key", "__text"))
    return map_texts(marked, ["__key", "__id1", "__id2"], "__text", make, "ids binary, n_seqs bigint")


def records(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = RECORDS, end: int = END, seed: int = 7, path: str = VOCABULARY) -> DataFrame:
    """slot, shard, position (byte in the shard), key, part, number, n_tokens and record, range-partitioned and sorted by slot."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (8 * parts - 1).bit_length()
    bucket = F.shiftrightunsigned("__id1", 64 - bits)
    before = Window.partitionBy("bucket").orderBy(F.shiftrightunsigned("__id1", 1), "__id1", "__id2").rowsBetween(Window.unboundedPreceding, -1)
    cut_up = sequences(documents, key, text, length, end, path).withColumn("bucket", bucket)
    # tokenised and sorted once; a bucket holds a range of the hash, so a number does not tell how many buckets there are
    done = written(cut_up.withColumn("at", F.coalesce(F.sum("n_seqs").over(before), F.lit(0))).select("__key", "ids", "bucket", "at", "n_seqs"))
    totals = sorted((r.bucket, r.n) for r in done.groupBy("bucket").agg(F.sum("n_seqs").alias("n")).collect())  # 16 numbers a partition at most
    starts, total = {}, 0
    for number, n in totals:
        starts[number] = total
        total += n
    width = 2 if end < 1 << 16 else 4
    stride = stride_of(length, end)
    order = Permutation(total, seed)
    first = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            which, part, number, n, rows = [], [], [], [], []
            for i, (ids, own, at) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                start = first.value[own] + at
                for p, a in enumerate(range(0, len(ids), width * length)):
                    x = ids[a : a + width * length]
                    which.append(i)
                    part.append(p)
                    number.append(start + p)
                    n.append(len(x) // width)
                    pad = np.array([end], f"<u{width}").tobytes() * (length - len(x) // width)
                    rows.append((len(x) // width).to_bytes(4, "little") + x + pad)
            slot = order.slots(np.array(number, np.int64))
            cols = [pa.array(slot, pa.int64()), pa.array(slot // per_shard, pa.int64()), pa.array(slot % per_shard * stride, pa.int64()), b.column(0).take(pa.array(which, pa.int64())), pa.array(part, pa.int32()), pa.array(number, pa.int64()), pa.array(n, pa.int32()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["slot", "shard", "position", key, "part", "number", "n_tokens", "record"])

    kind = done.schema["__key"].dataType.simpleString()
    out = done.select("__key", "ids", "bucket", "at").mapInArrow(cut, f"slot bigint, shard bigint, position bigint, `{key}` {kind}, part int, number bigint, n_tokens int, record binary")
    # slots are dense, so equal ranges of shards are equal shares, and no shard is cut
    shards = max(1, -(-total // per_shard))
    return out.repartitionByRange(min(shards, parts), "shard").sortWithinPartitions("shard", "slot")


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Write records as one file for each shard, shard=N/part-*, in a folder of any store that Spark writes; returns shard, path, n_records, bytes and crc32.

    Spark's committer moves files in place when all are whole, so lost tasks leave nothing behind; what the folder held before
    goes first, so no shard of another seed or input stays. Checksums are of the files as they are read back, and stand in
    folder/_manifest.json, which is written last: a folder without it is not finished.
    """
    spark = rows.sparkSession
    stride = rows.select(F.octet_length("record").alias("n")).first()
    remove(spark, f"{folder}/_manifest.json")
    # a string of any bytes is written as it is, with the line feed
    rows.select("shard", F.col("record").cast("string")).write.mode("overwrite").partitionBy("shard").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(folder)
    if stride is None:
        _save(spark, f"{folder}/_manifest.json", json.dumps({"stride": 0, "shards": []}))
        return spark.createDataFrame([], "shard bigint, path string, n_records bigint, bytes bigint, crc32 bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.crc32(b.column(2)[0].as_buffer())], pa.int64())], ["path", "bytes", "crc32"])

    sizes = files.select("path", F.col("length").alias("bytes"), "content").mapInArrow(sums, "path string, bytes bigint, crc32 bigint")
    found = sizes.select(F.regexp_extract("path", "shard=([0-9]+)/", 1).cast("long").alias("shard"), "path", (F.col("bytes") / (stride.n + 1)).cast("long").alias("n_records"), "bytes", "crc32")
    listed = sorted(tuple(r) for r in found.collect())  # a line for each shard of 8 MB
    _save(spark, f"{folder}/_manifest.json", json.dumps({"stride": stride.n + 1, "shards": [list(r) for r in listed]}))
    return spark.createDataFrame(listed, "shard bigint, path string, n_records bigint, bytes bigint, crc32 bigint")


def _save(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str, at: int = 0, size: int | None = None) -> bytes:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    file.seek(at)
    every = spark._jvm.org.apache.commons.io.IOUtils.toByteArray
    raw = bytes(every(file) if size is None else every(file, size))
    file.close()
    return raw


def manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(_read(spark, f"{folder}/_manifest.json"))


def read_records(spark: SparkSession, folder: str, slots: list[int], per_shard: int = RECORDS, width: int = 2) -> list[np.ndarray]:
    """The tokens of some slots, without the padding, by seeking."""
    told = manifest(spark, folder)
    stride, paths = told["stride"], {s[0]: s[1] for s in told["shards"]}
    out = []
    for s in slots:
        raw = _read(spark, paths[s // per_shard], s % per_shard * stride, stride)
        n = int.from_bytes(raw[:4], "little")
        out.append(np.frombuffer(raw[4 : 4 + width * n], f"<u{width}"))
    return out
