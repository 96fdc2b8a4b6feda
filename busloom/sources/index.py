"""A kept index of recordings: a table with a row for each piece of a file, so that readers go to what they ask for.

A row tells where a piece starts and stops, the number of its first row, what the pieces before it leave to it, and its zone. Spark filters
the table; only the pieces that are asked for are opened. Small files are surveyed in tasks that write their rows, large ones in groups, so the driver
never holds more of an index than one group's. A file that has changed since (size or time of change) is refused.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import UsageError
from ..schema import RAW
from .recording import WHOLE, Piece, Surveyed, _Part, check_inputs, dealt, few_tasks, framing_of, joined, pieces_reader, survey_file, survey_files
from .selection import KEYS, LISTS, Selection

#: Bytes of a piece, and how many are surveyed in one go: a row is some hundred bytes, and up to 30 kB with two thousand keys.
PIECE, GROUP = 2 << 20, 5_000
SCHEMA = "path string, size bigint, changed bigint, place int, start bigint, stop bigint, ts_format string, seq bigint, until_seq bigint, carry string, status string, low bigint, high bigint, " + ", ".join(f"{k}_bits bigint" for k in KEYS) + ", bare boolean"


def write_index(spark: SparkSession, paths: list[str], folder: str, piece: int = PIECE, **options) -> None:
    """Survey recordings and keep what is found in a folder of any store that Spark writes. Options are those of reading."""
    check_inputs(paths)
    framing = framing_of(options)
    spark.createDataFrame([], SCHEMA).write.mode("error").parquet(folder)
    sizes = {p: os.path.getsize(p) for p in paths}
    small = [p for p in paths if sizes[p] <= WHOLE]
    if small:  # surveyed and written where their task is, many to a task

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                for path in b.column(1).to_pylist():
                    rows = list(_rows(path, survey_file(0, path, framing, piece)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        names, types = zip(*((f.name, f.type) for f in to_arrow_schema(StructType.fromDDL(SCHEMA))), strict=True)
        dealt(spark, list(enumerate(small)), [sizes[p] for p in small]).mapInArrow(run, SCHEMA).write.mode("append").parquet(folder)
    for group in _groups([p for p in paths if sizes[p] > WHOLE], piece):
        found = survey_files(spark, group, framing, piece)
        rows = [r for path, f in zip(group, found, strict=True) for r in _rows(path, f)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _groups(paths: list[str], piece: int) -> Iterator[list[str]]:
    group, n = [], 0
    for p in paths:
        if group and n >= GROUP:
            yield group
            group, n = [], 0
        group.append(p)
        n += os.path.getsize(p) // piece + 1
    if group:
        yield group


def _rows(path: str, found: Surveyed) -> Iterator[tuple]:
    st = os.stat(path)
    ends = [p.seq for p in found.pieces[1:]] + [None]
    for i, (p, end) in enumerate(zip(found.pieces, ends, strict=True)):
        z = p.zone or {"low": None, "high": None, "bits": dict.fromkeys(KEYS, 0), "bare": False}
        yield (path, st.st_size, st.st_mtime_ns, i, p.start, p.stop, p.ts_format, p.seq, end, json.dumps(p.carry), p.status, z["low"], z["high"], *(z["bits"][k] for k in KEYS), z["bare"])


def _may_hold(select: Selection) -> Column:
    """Selection.may_hold as a condition on the rows of an index; tests on keys are left to the source."""
    def side(column: str, op: str, values: tuple[int, ...]) -> Column | None:
        if column not in ("stamp", "time_us") or op not in (">=", "<="):
            return None
        own = F.col("high") >= values[0] if op == ">=" else F.col("low") <= values[0]
        return own | (F.col("ts_format") != "irig") if column == "time_us" else own

    conditions = [c for t in select.tests if (c := side(*t)) is not None]
    for name, values in select.lists.items():
        which, _, of = name.partition("_")
        held = F.col(f"{LISTS[of]}_bits")
        mask = sum(1 << v for v in set(values) if 0 <= v < 63)  # no key has such a value
        if which == "include":
            conditions.append(held.bitwiseAND(F.lit(mask).cast("long")) != 0)
        else:
            other = held.bitwiseAND(F.lit(~mask).cast("long")) != 0
            conditions.append(other | F.col("bare") if of in ("rts", "subaddresses") else other)
    return reduce(lambda a, b: a & b, conditions, F.col("low").isNotNull())


def find(spark: SparkSession, folder: str, select: Selection | None = None, paths: list[str] | None = None, first: int | None = None, until: int | None = None) -> list[Piece]:
    """The pieces that may hold what is asked for: by a selection, in some files (all by default), from row number first up to until of each.

    file_index counts the files in the order of paths, or of their names.
    """
    index = _asked(spark, folder, select, paths, first, until)
    found = index.orderBy("file_index", "place").collect()  # pieces that are opened, a row for each
    _unchanged(found)
    return [Piece(**_piece(r.asDict())) for r in found]


def _asked(spark: SparkSession, folder: str, select: Selection | None, paths: list[str] | None, first: int | None, until: int | None) -> DataFrame:
    """The rows of an index that may hold what is asked for, with file_index."""
    index = spark.read.schema(SCHEMA).parquet(folder)
    if paths is None:
        paths = [r.path for r in index.select("path").distinct().orderBy("path").collect()]
    order = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "__path string, file_index int")
    index = index.join(order, F.col("path") == F.col("__path")).drop("__path")
    if select:
        index = index.filter(_may_hold(select))
    if until is not None:
        index = index.filter(F.col("seq") < until)
    if first is not None:
        index = index.filter(F.col("until_seq").isNull() | (F.col("until_seq") > first))
    return index


def _piece(r: dict) -> dict:
    """The fields of a Piece, of a row."""
    return {k: r[k] for k in ("file_index", "path", "start", "stop", "ts_format", "seq", "status")} | {"carry": json.loads(r["carry"]), "zone": {"low": r["low"], "high": r["high"], "bits": {k: r[f"{k}_bits"] for k in KEYS}, "bare": r["bare"]}}


def _changed(path: str, size: int, changed: int) -> bool:
    st = os.stat(path) if os.path.exists(path) else None
    return st is None or (st.st_size, st.st_mtime_ns) != (size, changed)


def _unchanged(rows: Iterable) -> None:
    for path, size, changed in {(r.path, r.size, r.changed) for r in rows}:
        if _changed(path, size, changed):
            raise UsageError(f"{path} has changed since it was indexed")


def read_indexed(spark: SparkSession, folder: str, select: Selection | None = None, paths: list[str] | None = None, first: int | None = None, until: int | None = None, **options) -> DataFrame:
    """Raw rows of indexed recordings: those selected, with numbers (seq) from first up to until. Options are those of reading.

    Rows of the index go to the tasks that read their pieces, many to a task where pieces are small; none comes to the driver.
    """
    asked = _asked(spark, folder, select, paths, first, until)

    def look(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            yield b.filter(pa.array([_changed(*r.values()) for r in b.to_pylist()], pa.bool_()))

    bad = asked.select("path", "size", "changed").distinct().mapInArrow(look, "path string, size bigint, changed bigint").select(F.min("path")).first()[0]
    if bad is not None:
        raise UsageError(f"{bad} has changed since it was indexed")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.coalesce("stop", "size") - F.greatest("start", F.lit(0))), F.lit(0))).first()
    reader = pieces_reader(select, **options)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(rows for b in found for r in b.to_pylist() if reader._wanted(p := _piece(r)) for rows in reader.read(_Part(p)))

    rows = asked.repartitionByRange(few_tasks(spark, n, size), "file_index", "place").sortWithinPartitions("file_index", "place").mapInArrow(run, RAW)
    rows = rows if first is None else rows.filter(F.col("seq") >= first)
    return rows if until is None else rows.filter(F.col("seq") < until)
