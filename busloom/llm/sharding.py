"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's hash and the number of shards alone decide the shard; there is no table of a ring. With one more shard a key either
stays or moves into the new shard. Slots number the rows of a shard without gaps.

Slots follow a hash of the key, or the order in which an ordered table stands in its files: then each shard holds its rows in the
order of training.

The key is hashed as text, so equal ids of any type fall together. Null ids are one key. Repeated rows each get a slot of
their own. A null text has no bytes and no checksum of its own: it counts as empty. An empty table gives no rows. Columns other
than the named ones are not read, unless they are asked for; of those, one with the name of a column made here gives way to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered

ROWS_PER_BUCKET = 2_000
#: Bytes that a row costs beside its text.
ROW_BYTES = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError(f"shards: {shards}")
    key = keys.astype(np.uint64)
    shard = np.full(len(key), -1, np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = j[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)
            j[live] = np.floor((shard[live] + 1) * step).astype(np.int64)
            live = live[j[live] < shards]
    return shard


#: Columns that sharding makes.
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(documents: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), in_file_order: bool = False) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of each row, and the columns to keep.

    With in_file_order, documents are read from files (part-N) whose rows have an order, by N and within a file: slots follow it.
    """
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long") + ROW_BYTES
    keep = tuple(c for c in keep if c != key and c not in MADE)
    picked = [F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("__hash"), F.col(f"`{key}`").alias("__key"), size.alias("__size"), F.crc32(raw).alias("__crc"), *(F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep))]
    if in_file_order:
        name = documents.metadataColumn("_metadata")["file_path"]
        number = F.regexp_extract(name, "part-([0-9]+)[^/]*$", 1).try_cast("long")
        picked += [F.struct(number.alias("n"), F.xxhash64(name).alias("h")).alias("__file"), documents.metadataColumn("_metadata")["row_index"].alias("__row")]
    rows = documents.select(*picked)

    @F.pandas_udf("int")
    def shard_of(h: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy().view(np.uint64), int(n.iloc[0])) if len(h) else h, dtype="int32")

    dealt = rows.withColumns({"__shard": F.coalesce(shard_of("__hash", F.lit(shards)), F.lit(0)), "__grown": shard_of("__hash", F.lit(shards + 1))})
    # totals by range need the hash alone, so that the texts are read once
    if in_file_order:
        out = numbered(dealt, ["__shard"], [], F.col("__row"), ROWS_PER_BUCKET, nullable=False, ranges=F.col("__file"))
    else:
        out = numbered(dealt, ["__shard"], [F.col("__hash"), F.col("__key"), F.col("__crc"), F.col("__size")], F.xxhash64(F.col("__hash"), F.lit(9)), ROWS_PER_BUCKET, nullable=False)
    return out.select(*(F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)), F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("__shard").alias("shard"), F.col("start").alias("slot"), F.col("__grown").alias("grown_shard"))
