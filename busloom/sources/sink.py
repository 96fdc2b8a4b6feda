"""The CSV table: rows, files, and how they get their names."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CalendarError, OutputExists, UsageError
from ..functions import render, words
from ..operators.order import MAX_GROUP, Runs
from ..schema import CSV_COLUMNS, SPURIOUS_TYPE


def csv_rows(df: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """The 46 columns of the table, all text; what is absent is empty. And more columns of df."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    spurious = F.col("message_type") == SPURIOUS_TYPE
    out: dict[str, Column] = {c: F.lit("") for c in CSV_COLUMNS}
    out["TIME_STAMP"] = text(F.col("timestamp"))
    out["RT"] = text(F.col("rt"))
    out["MSG"] = text(F.col("msg_label"))
    for i in range(32):
        out[f"WD{i + 1:02d}"] = text(words.hex_word(F.get("data_words", F.lit(i))))
    out["STAT"] = text(words.hex_word(F.col("status_word")))
    out["CMD"] = text(words.hex_word(F.col("command_word")))
    out["MUX"] = text(F.col("mux"))
    out["BUS"] = words.bus_name(F.col("bus"))
    out["DELTA"] = text(render.seconds6(F.col("delta_us")))
    out["ERROR"] = words.error_label(spurious, F.col("error"))
    out["ERROR_CODE"] = text(words.hex_word(F.col("error_word")))
    return df.select(*(c.alias(n) for n, c in out.items()), *(more or []))


def split_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an error label, and those with one."""
    marked = (F.col("message_type") == SPURIOUS_TYPE) | F.col("error")
    return df.filter(~marked), df.filter(marked)


def check_calendar(df: DataFrame, time_format: str, year: int | None) -> None:
    """A calendar rendering needs a year, a clock locked to the calendar, and days that the year has."""
    if time_format == "doy":
        return
    if time_format not in ("iso", "dom"):
        raise UsageError(f"time format {time_format!r}")
    if year is None:
        raise CalendarError("a calendar rendering needs a year")
    if not 1 <= year <= 9999:
        raise CalendarError(f"year {year}: 1 to 9999")
    y = F.lit(year)
    why = F.when(F.col("day_of_year").isNull(), "counter times").when(F.col("freerun"), "a free-running clock").when(words.date_of(y, F.col("day_of_year")).isNull(), "a day that the year hasn't")
    bad = df.select(why.alias("why"), "file_offset").filter("why is not null").limit(1).collect()
    if bad:
        raise CalendarError(f"record at 0x{bad[0].file_offset:X}: {bad[0].why}")


def errors_path(path: str) -> str:
    stem, suffix = os.path.splitext(path)
    return f"{stem}_errors{suffix}"


@dataclass
class Written:
    path: str
    rows: int


def names_of(path: str, split: bool) -> list[str]:
    """Every name that a run may write."""
    names = [path, errors_path(path)] if split else [path]
    return [*names, *(f"{p}.partial" for p in names)]


def refuse_inputs(outputs: list[str], inputs: list[str]) -> None:
    """An output may not be an input, however either is spelt: by path, through links, or as another name of the same file."""
    for o in outputs:
        for i in inputs:
            if os.path.realpath(o) == os.path.realpath(i) or os.path.exists(o) and os.path.exists(i) and os.path.samefile(o, i):
                raise UsageError(f"{o}: an input")


class CsvFile:
    """One file, put together beside its place and then moved there in one step."""

    def __init__(self, path: str, no_clobber: bool = False, partial: bool = False) -> None:
        self.path = f"{path}.partial" if partial else path
        self.no_clobber = no_clobber
        self.temporary = os.path.join(os.path.dirname(os.path.abspath(path)), f".{os.path.basename(path)}.{uuid.uuid4().hex}.tmp")
        self.check()

    def check(self) -> None:
        if os.path.isdir(self.path):
            raise UsageError(f"{self.path}: a folder")
        if self.no_clobber and os.path.exists(self.path):
            raise OutputExists(self.path)

    def place(self, spark: SparkSession, parts: list[tuple[str | None, bytes]], rows: int) -> Written:
        """The header, then files and bytes one after the other. Tasks bring the files in: sums of their sizes tell where each begins, so all are copied at once.

        The driver writes the header and the few bytes between the files. A task that runs again writes the same bytes to the same place; files stay until all is there.
        """
        head = _header()
        at, copies, small = len(head), [], [(0, head)]
        for path, more in parts:
            if path is not None and (size := os.path.getsize(path)):
                copies.append((path, at, size))
                at += size
            if more:
                small.append((at, more))
                at += len(more)
        try:
            with open(self.temporary, "wb") as f:
                f.truncate(at)
                for where, data in small:
                    f.seek(where)
                    f.write(data)
                f.flush()
                os.fsync(f.fileno())
            _bring(spark, self.temporary, copies)
            self.commit()
        except BaseException:
            if os.path.exists(self.temporary):
                os.remove(self.temporary)
            raise
        return Written(self.path, rows)

    def commit(self) -> None:
        if self.no_clobber:
            try:
                os.link(self.temporary, self.path)  # fails if the name is taken, also by one who came meanwhile
            except FileExistsError:
                raise OutputExists(self.path) from None
            os.remove(self.temporary)
        else:
            os.replace(self.temporary, self.path)


def _header() -> bytes:
    return (",".join(CSV_COLUMNS) + "\n").encode()


def _bring(spark: SparkSession, target: str, copies: list[tuple[str, int, int]]) -> None:
    """Copy files to their places in another that is there and long enough, a task for each."""
    if not copies:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at, size in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                with open(path, "rb") as g, open(target, "r+b") as f:
                    if os.fstat(g.fileno()).st_size != size:
                        raise OSError(f"{path}: not the {size} bytes that were written")
                    f.seek(at)
                    _copy(g, f)
                    f.flush()
                    os.fsync(f.fileno())
            yield b.select([0])

    listed = spark.createDataFrame([(i, *c) for i, c in enumerate(copies)], "i int, path string, at long, size long")
    listed.repartitionById(len(copies), listed.i).mapInArrow(run, "i int").count()


def write_all(f, parts: list[tuple[str | None, bytes]]) -> None:
    """The header and all parts; what is copied is removed, so that no more than one part stands twice on the disk."""
    f.write(_header())
    for path, more in parts:
        if path is not None:
            f.flush()
            with open(path, "rb") as g:
                _copy(g, f)
            os.remove(path)
        f.write(more)


def _copy(g, f) -> None:
    """All of a file behind what is in f: by the kernel where both are files, else through memory."""
    left = os.fstat(g.fileno()).st_size
    try:
        at = f.tell()
        while left:
            left -= (n := os.copy_file_range(g.fileno(), f.fileno(), left, offset_dst=at))
            at += n
            if not n:
                break
        f.seek(at)
    except (OSError, AttributeError):  # io.UnsupportedOperation is an OSError: a stream without a file
        shutil.copyfileobj(g, f, 1 << 24)


@dataclass
class Parts:
    """The lines of a table in files of a folder, in the order of partitions: those without an error label, and those with one if asked for."""

    folder: str
    main: list[tuple[str | None, bytes]]
    errors: list[tuple[str | None, bytes]]
    rows: int = 0
    error_rows: int = 0
    capped: int = 0


def write_parts(rows: DataFrame, folder: str, split: bool = False, max_group: int = MAX_GROUP) -> Parts:
    """Write the lines of rows, a file for each task, in canonical order. folder is one that all executors see.

    Rows come in the order of arrival, or of a merge, from partition to partition and in each, and no run of equal times goes on
    in the next partition. What a run's order still hangs on is the first row of the next: where that matters, both
    orders of a partition's last run are told, and the driver takes the right one.
    """
    os.makedirs(folder, exist_ok=True)
    key = F.when(F.col("rt").isNotNull(), F.col("rt") * 64 + F.col("subaddress") * 2 + F.col("direction")).otherwise(-1)
    stamp = F.coalesce(*(F.col(c) for c in ("ticks", "time_us") if c in rows.columns), F.lit(-1)).cast("long")
    marked = (F.col("message_type") == SPURIOUS_TYPE) | F.col("error") if split else F.lit(False)
    lines = csv_rows(rows, [stamp.alias("__stamp"), key.cast("int").alias("__key"), marked.alias("__bad")])
    line = F.concat(F.concat_ws(",", *(cell(F.col(c)) if c in FREE_TEXT else F.col(c) for c in CSV_COLUMNS)), F.lit("\n")).alias("line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = os.path.join(folder, f"{number:06d}-{uuid.uuid4().hex}")
        runs, held, n = Runs(max_group), None, [0, 0]
        files = [open(f"{name}.{kind}", "wb") for kind in ("main", "errors")[: 1 + split]]

        def put(text: pa.Array, bad: np.ndarray) -> None:
            for kind, f in enumerate(files):
                own = text.filter(pa.array(bad == bool(kind))) if split else text
                n[kind] += len(own)
                f.write(_joined(own))

        try:
            for b in batches:
                if held is not None:
                    b = pa.concat_batches([held, b])
                stamps, keys, bad = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
                order, last = runs.places(stamps, keys)
                text = b.column(3).slice(0, last)
                same = bool((order[1:] > order[:-1]).all())
                put(text if same else text.take(pa.array(order)), bad[:last] if same else bad[order])
                held = b.slice(last)
        finally:
            for f in files:
                f.close()
        ends: list[list[bytes]] = [[b"", b""], [b"", b""]]  # by kind: the last run if the next partition opens with a key, and if not
        if held is not None and held.num_rows:
            keys, bad = (held.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for free in (False, True):
                order = np.array(runs.run(keys, free, again=free))
                text = held.column(3).take(pa.array(order))
                for kind in range(1 + split):
                    ends[kind][free] = _joined(text.filter(pa.array(bad[order] == bool(kind))) if split else text)
            n[0] += int((~bad).sum()) if split else len(bad)
            n[1] += int(bad.sum()) if split else 0
        out = {"number": number, "name": name, "rows": n[0], "error_rows": n[1], "capped": runs.capped, "free": runs.opens_free}
        for kind, k in ((0, "main"), (1, "errors")):
            out |= {f"{k}_end": ends[kind][0], f"{k}_free": ends[kind][1] if ends[kind][1] != ends[kind][0] else None}
        yield pa.RecordBatch.from_pylist([out], schema=_PART)

    shape = "number int, name string, rows bigint, error_rows bigint, capped bigint, free boolean, main_end binary, main_free binary, errors_end binary, errors_free binary"
    found = lines.select("__stamp", "__key", "__bad", line).mapInArrow(run, shape).collect()  # a row for each task, with the lines of one run
    out = Parts(folder, [], [])
    next_free = False
    for r in sorted(found, key=lambda r: -r.number):
        for parts, kind in ((out.main, "main"), (out.errors, "errors")):
            end = r[f"{kind}_free"] if next_free and r[f"{kind}_free"] is not None else r[f"{kind}_end"]
            parts.append((f"{r.name}.{kind}" if kind == "main" or split else None, bytes(end)))
        out.rows, out.error_rows, out.capped = out.rows + r.rows, out.error_rows + r.error_rows, out.capped + r.capped
        if r.free is not None:
            next_free = r.free
    out.main.reverse()
    out.errors.reverse()
    return out


_PART = pa.schema([("number", pa.int32()), ("name", pa.string()), ("rows", pa.int64()), ("error_rows", pa.int64()), ("capped", pa.int64()), ("free", pa.bool_()), ("main_end", pa.binary()), ("main_free", pa.binary()), ("errors_end", pa.binary()), ("errors_free", pa.binary())])


def _joined(text: pa.Array) -> bytes:
    """The bytes of an array of strings, one after the other."""
    if not len(text):
        return b""
    offsets = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1]
    return memoryview(text.buffers()[2])[int(offsets[0]) : int(offsets[-1])].tobytes()


#: Columns whose text comes from outside; the others are made of digits, letters and marks that need no quotes.
FREE_TEXT = ("MUX",)
def cell(c: Column) -> Column:
    """A value in quotes where it holds a quote, a comma or a line end."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_folder(rows: DataFrame, folder: str, order: list | None = None) -> None:
    """The table as many files in a folder of any store, written in parallel; sorted, files follow each other in order."""
    out = csv_rows(rows.orderBy(*order) if order else rows)
    out.write.csv(folder, header=True, emptyValue="", quote='"', escape='"', lineSep="\n")
