"""The 'recording' data source: Arrow batches of raw records, from the pieces of files.

Files are framed twice. The first pass takes all pieces at once: each guesses a record shortly before its start, follows the chain to
a record beyond its end, and tells where it stood, how many records there are and what it leaves to the next. The driver leads the true
chain through these few rows; a piece whose guess was wrong is read again from the right place. The second pass gives the rows
of all pieces at once, each from a known record on and with what the pieces before it have left.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not

from ..errors import EmptyFile, FileMissing, FileUnreadable, UsageError
from ..schema import RAW
from .facts import NEVER, Carry, cut_points, facts
from .framing import BLOCK_BYTES, MOST_TOLD, Framer, Options, Records, Resync
from .inputs import MAX_FILES, mux_of
from .selection import KEYS, NONE, Selection, Zone, keys_of

_ARROW = pa.schema([("file_index", pa.int32()), ("source_path", pa.string()), ("seq", pa.int64()), ("file_offset", pa.int64()), ("kind", pa.string()), ("ts_format", pa.string()), ("type_word", pa.int32()), ("t0", pa.int32()), ("t1", pa.int32()), ("t2", pa.int32()), ("body", pa.list_(pa.int32())), ("mux", pa.string()), ("detail", pa.string()), ("parent", pa.list_(pa.int32())), ("stamp", pa.int64()), ("prev_stamp", pa.int64()), ("high", pa.int64()), ("back", pa.bool_())])
#: Columns that a scan adds, to be filtered by.
_KEYED = pa.schema([*_ARROW, *((k, pa.int32()) for k in KEYS)])
BATCH = 50_000
#: Bytes of a piece of a file: as many as there are cores for, within these bounds.
LEAST_PIECE, MOST_PIECE = 1 << 20, 32 << 20
#: Records that must follow from a guess, and bytes before a piece at which it is made, so that what is right before the piece is known.
DEPTH, RUN_UP = 32, 8192


def _options(given: dict[str, str]) -> tuple[Options, dict]:
    flag = lambda name, default: given.get(name, default).lower() == "true"
    framing = Options(given.get("inputtimeformat", given.get("input_time_format", "auto")), flag("strict", "false"), int(given.get("detect_records", 8)), int(given.get("lookahead_records", 2)))
    mux = {"enabled": flag("mux_enabled", "true"), "delimiter": given.get("mux_delimiter", "."), "index": int(given.get("mux_field", 4)), "value": given.get("mux_value")}
    return framing, mux


def batches(framer: Framer, index: int, path: str, mux: str | None, seq: int = 0, carry: Carry | None = None, stop: int | None = None, status: str | None = "", body_words: int = 64, select: Selection | None = None, keyed: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of one file, or of a piece up to the record at stop: records and markers in arrival order, then the status.

    status: what the status row tells, if not the framer's own; None for no such row. select: which records become rows; what is told of them
    is the same as if all did. keyed: whether rows have their keys as columns.
    """
    carry, gap = carry or Carry(), False

    schema = _KEYED if keyed else _ARROW
    absent = [pa.nulls(1, f.type) for f in schema]

    def marker(kind: str, offset: int, detail: str) -> pa.RecordBatch:
        row = {"file_index": index, "source_path": path, "seq": seq, "file_offset": offset, "kind": kind, "ts_format": framer.status.ts_format, "mux": mux, "detail": detail}
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) if f.name in row else none for f, none in zip(schema, absent, strict=True)], schema=schema)

    markers = not (select and select.tests)

    for item in framer:
        if isinstance(item, Resync):
            if stop is not None and item.offset >= stop:
                break
            if markers:
                yield marker("resync", item.offset, f"0x{item.resumed:X}: {item.reason}")
            seq, gap = seq + 1, True
            continue
        whole = stop is None or item.offsets[-1] < stop
        if not whole:
            item = item.upto(int(np.searchsorted(item.offsets, stop)))
        if len(item.offsets):
            yield from _record_batches(item, framer.status.ts_format, index, path, mux, seq, carry, gap, body_words, select, keyed)
            seq, gap = seq + len(item.offsets), False
        if not whole:
            break
    if status is not None and markers:
        yield marker("status", framer.status.stop_offset, status or json.dumps(vars(framer.status)))


def _record_batches(item: Records, ts: str, index: int, path: str, mux: str | None, seq: int, carry: Carry, gap: bool, body_words: int, select: Selection | None, keyed: bool) -> Iterator[pa.RecordBatch]:
    width = 3 if ts == "irig" else 2
    told = facts(item.counts, item.words, width, carry, gap)
    words, firsts = item.words, np.concatenate([[0], np.cumsum(item.counts)])
    follows = np.concatenate([[0], np.cumsum(told.follows)])
    known = lambda v: pa.array(v, mask=v == NEVER)
    keys = keys_of(words[firsts[:-1]], words[firsts[:-1] + 1 + width]) if select or keyed else {}
    kept = None
    if select:
        parents = np.array([(p[0], p[1 + width]) for p in told.parents], np.int64).reshape(-1, 2)
        kept = np.flatnonzero(select.wanted(ts, told.stamp, keys, told.follows, keys_of(parents[:, 0], parents[:, 1])))
    most = len(item.offsets) if kept is None else len(kept)
    for lo in range(0, most, BATCH):
        hi = min(lo + BATCH, most)
        n, i = hi - lo, slice(lo, hi) if kept is None else kept[lo:hi]
        at = firsts[:-1][i]
        lengths = np.minimum(item.counts[i] - 1 - width, body_words)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        body = words[np.repeat(at + 1 + width - ends[:-1], lengths) + np.arange(ends[-1])].astype(np.int32)
        same = lambda v, t: pa.repeat(pa.scalar(v, t), n) if v is not None else pa.nulls(n, t)
        stamp = [pa.array(words[at + 1 + k].astype(np.int32)) if k < width else pa.nulls(n, pa.int32()) for k in range(3)]
        parents_of: list = [None] * n
        continued = np.flatnonzero(told.follows[i]).tolist()
        for j in continued:
            parents_of[j] = told.parents[follows[lo + j if kept is None else i[j]]]
        place = np.arange(seq + lo, seq + hi) if kept is None else seq + i
        cols = [pa.array(np.full(n, index, np.int32)), same(path, pa.string()), pa.array(place), pa.array(item.offsets[i]), same("rec", pa.string()), same(ts, pa.string()), pa.array(words[at].astype(np.int32)), *stamp, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(body)), same(mux, pa.string()), pa.nulls(n, pa.string())]
        cols += [pa.array(parents_of, pa.list_(pa.int32())) if continued else pa.nulls(n, pa.list_(pa.int32())), pa.array(told.stamp[i]), known(told.prev[i]), known(told.high[i]), pa.array(told.back[i])]
        cols += [pa.array(v[i].astype(np.int32), mask=v[i] == NONE) for v in keys.values()] if keyed else []
        yield pa.RecordBatch.from_arrays(cols, schema=_KEYED if keyed else _ARROW)


@dataclass
class Piece:
    """A part of a file: the records from start up to that at stop (null: to the end), and what the pieces before it leave."""

    file_index: int
    path: str
    start: int
    stop: int | None
    ts_format: str
    seq: int
    carry: dict
    status: str | None = None
    zone: dict | None = None


class _Part(InputPartition):
    def __init__(self, piece: dict) -> None:
        self.piece = piece


class _Reader(DataSourceReader):
    def __init__(self, given: dict[str, str]) -> None:
        self.given = given
        self.framing, self.mux = _options(given)
        self.body_words = int(given.get("body_words", 64))  # the longest record has fewer
        self.select, self.keyed = Selection.loads(given.get("select")), given.get("keyed") == "true"
        if "pieces" in given:
            self.pieces = json.loads(given["pieces"])
            return
        listed = given.get("paths") or given.get("path")
        if not listed:
            raise UsageError("no input path")
        paths = json.loads(listed) if listed.startswith("[") else [listed]
        if len(paths) > MAX_FILES:
            raise UsageError(f"{len(paths)} inputs; {MAX_FILES} at most")
        self.pieces = [{"file_index": i, "path": p} for i, p in enumerate(paths)]

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.pieces if self._wanted(p)]

    def _wanted(self, p: dict) -> bool:
        if not self.select or "start" not in p:
            return True
        if p["start"] < 0:
            return not self.select.tests
        return p["zone"] is None or self.select.may_hold(Zone(**p["zone"]), p["ts_format"])

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no piece holds what is wanted
            return
        p, more = part.piece, {"select": self.select, "keyed": self.keyed}
        mux = mux_of(p["path"], **self.mux)
        with _opened(p["path"]) as (fetch, size):
            if "start" not in p:
                yield from batches(Framer(fetch, size, self.framing), p["file_index"], p["path"], mux, **more)
            elif p["start"] < 0:  # a file without records
                yield from batches(Framer(fetch, 0), p["file_index"], p["path"], mux, status=p["status"], **more)
            else:
                framer = Framer(fetch, size, self.framing, min(BLOCK_BYTES, (p["stop"] or size) - p["start"]), p["start"], p["ts_format"])
                yield from batches(framer, p["file_index"], p["path"], mux, p["seq"], Carry.unpacked(p["carry"]), p["stop"], p["status"], self.body_words, **more)


class _PushingReader(_Reader):
    """Takes plain filters on keys and stamps from Spark, which then doesn't look at them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            tests = _tests(f)
            if tests is None:
                yield f
            else:
                self.select = self.select.also(tests)


def _tests(f: Filter) -> list[tuple[str, str, tuple[int, ...]]] | None:
    """A filter of Spark as tests of a selection; None if it has none that are equal to it."""
    negated = isinstance(f, Not)
    f = f.child if negated else f
    if len(f.attribute) != 1 if hasattr(f, "attribute") else True:
        return None
    column = f.attribute[0]
    if column == "kind" and isinstance(f, EqualTo) and f.value == "rec" and not negated:
        return [("stamp", ">=", (NEVER,))]
    if column not in (*KEYS, "stamp"):
        return None
    if isinstance(f, IsNotNull):
        return None if negated else [(column, ">=", (NEVER,))]
    values = tuple(f.value) if isinstance(f, In) else (f.value,) if hasattr(f, "value") else ()
    if not values or any(type(v) is not int for v in values):
        return None
    if isinstance(f, (EqualTo, In)):
        return [(column, "not in" if negated else "in", values)]
    least = {GreaterThan: 1, GreaterThanOrEqual: 0}.get(type(f))
    most = {LessThan: -1, LessThanOrEqual: 0}.get(type(f))
    if least is None and most is None:
        return None
    v = values[0]
    if least is not None:
        return [(column, "<=", (v + least - 1,)) if negated else (column, ">=", (v + least,))]
    return [(column, ">=", (v + most + 1,)) if negated else (column, "<=", (v + most,))]


class _opened:
    def __init__(self, path: str) -> None:
        self.path = path

    def __enter__(self):
        try:
            self.file = open(self.path, "rb")
            return self.fetch, os.fstat(self.file.fileno()).st_size
        except FileNotFoundError:
            raise FileMissing(self.path) from None
        except OSError as e:
            raise FileUnreadable(f"{self.path}: {e}") from None

    def fetch(self, offset: int, size: int) -> bytes:
        try:
            self.file.seek(offset)
            return self.file.read(size)
        except OSError as e:
            raise FileUnreadable(f"{self.path}: {e}") from None

    def __exit__(self, *_) -> None:
        self.file.close()


class RecordingSource(DataSource):
    """spark.read.format('recording'): option path, or paths (a JSON list), in a folder that all executors see. A file is one task then; read_raw cuts it."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self):
        return RAW + "".join(f", {k} int" for k in KEYS) if self.options.get("keyed") == "true" else RAW

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushing") == "true" else _Reader)(dict(self.options))


def survey(path: str, start: int, border: int | None, framing: Options, sure: bool) -> dict:
    """What a piece is like from start (a record if sure, else to be guessed) to its cut behind border.

    Gives start and stop (offsets of the records at its cuts; stop is null where the file ends), records, resyncs, ts_format, status, carry, steps back
    in time, the first of them and the first record's stamp; or nothing but a status if the file is refused, or no record was found.
    """
    with _opened(path) as (fetch, size):
        head = Framer(fetch, size, framing)
        first = head.head()
        told = vars(head.status)
        if first is None:
            return {"start": -1, "status": told}
        ts = head.status.ts_format
        at = first if start == 0 else start if sure else head.resume(max(first, start - RUN_UP), DEPTH)
        if at is None:
            return {"start": -2, "status": told}
        # a wrong guess soon meets what isn't a record: there strict reading would tell nothing of where the piece stops
        lenient = framing.strict and start > 0 and not sure
        framer = Framer(fetch, size, replace(framing, strict=False) if lenient else framing, min(BLOCK_BYTES, (border or size) - start), at, ts)
        carry, gap, width = Carry(), False, 3 if ts == "irig" else 2
        out = {"start": at if sure or start == 0 else None, "stop": None, "records": 0, "resyncs": 0, "ts_format": ts, "back": 0, "first_back": None, "first": None, "accepted": 0}
        seq = passed = 0
        zone = Zone()
        losses: list[str] = []
        for item in framer:
            if isinstance(item, Resync):
                passed += 1
                if out["start"] is not None:
                    out["resyncs"] += 1
                    seq += 1
                    losses.append(f"sync lost at 0x{item.offset:X}: {item.reason}")
                gap = True
                continue
            lo, hi = 0, len(item.offsets)
            f = facts(item.counts, item.words, width, (before := Carry() if out["start"] is None else Carry.unpacked(carry.packed())), gap)
            if out["start"] is None or border is not None and item.offsets[-1] >= border:
                cuts = cut_points(f, item.counts, item.words)
                cuts = cuts[item.offsets[cuts] >= start]
                if out["start"] is None:
                    if not len(cuts):
                        gap = False
                        continue
                    lo = int(cuts[0])
                    out["start"] = int(item.offsets[lo])
                if border is not None:
                    behind = cuts[item.offsets[cuts] >= border]
                    if len(behind) and int(behind[0]) >= lo:
                        hi = int(behind[0])
                        out["stop"] = int(item.offsets[hi])
            if lo or hi < len(item.offsets):
                item = item.upto(hi).behind(lo)
                before = Carry() if lo else carry
                f = facts(item.counts, item.words, width, before, gap and not lo) if len(item.offsets) else None
            carry, gap = before, False
            if f is not None and len(item.offsets):
                begin = np.concatenate([[0], np.cumsum(item.counts)[:-1]])
                zone.add(f.stamp, f.follows, keys_of(item.words[begin], item.words[begin + 1 + width]))
                good = np.flatnonzero(f.accepted)
                out["accepted"] += len(good)
                if out["first"] is None and len(good):
                    i = int(good[0])
                    up = int(item.words[int(item.counts[:i].sum()) + 1])
                    out["first"] = {"stamp": int(f.stamp[i]), "freerun": bool(ts == "irig" and up >= 0x8000), "seq": seq + i}
                steps = np.flatnonzero(f.back)
                if len(steps) and out["first_back"] is None:
                    out["first_back"] = seq + int(steps[0])
                out["back"] += len(steps)
                out["records"] += len(item.offsets)
                seq += len(item.offsets)
            if out["stop"] is not None:
                break
        if out["start"] is None:
            return {"start": -2, "status": told}
        # what the framer met before the piece isn't of it; a loss from which it didn't recover has no marker
        own = framer.status
        last = own.sync_losses - passed if out["stop"] is None else 0
        others = [w for w in own.warnings if not w.startswith("sync lost")]
        losses += [f"sync lost at 0x{own.stop_offset:X}: {framer.why}"] * (last if own.state != "complete" and not framing.strict else 0)
        state = own.state if own.state != "partial-recovered" or out["resyncs"] or last else "complete"
        if own.state == "truncated-tail" and out["resyncs"]:
            state = "partial-recovered"
        status = vars(own) | {"records": out["records"], "sync_losses": out["resyncs"] + last, "warnings": (told["warnings"] if start == 0 else []) + losses[:MOST_TOLD] + others, "state": state}
        return out | {"status": status, "carry": carry.packed(), "zone": asdict(zone), "again": lenient and state != "complete"}


@dataclass
class Surveyed:
    """How a file was framed: its pieces, how it ended, and what is known of its records in all."""

    pieces: list[Piece]
    status: dict
    back: int = 0
    first_back: int | None = None
    first: dict | None = None
    accepted: int = 0


def _job(spark: SparkSession, tasks: list[dict], framing: Options) -> list[dict]:
    """Survey pieces on the executors, a task for each."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for i, t in zip(b.column(0).to_pylist(), map(json.loads, b.column(1).to_pylist()), strict=True):
                got = survey(t["path"], t["start"], t["border"], framing, t["sure"])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([json.dumps(got)])], ["i", "got"])

    listed = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(tasks)], "i long, task string")
    rows = listed.repartitionById(len(tasks), listed.i.cast("int")).mapInArrow(run, "i bigint, got string").collect()  # a row for each piece
    return [json.loads(r.got) for r in sorted(rows, key=lambda r: r.i)]


def survey_files(spark: SparkSession, paths: list[str], framing: Options, piece: int | None = None) -> list[Surveyed]:
    """Cut files into pieces at records that all agree on."""
    sizes = [os.path.getsize(p) for p in paths]
    if piece is None:
        piece = max(LEAST_PIECE, min(MOST_PIECE, sum(sizes) // (2 * spark.sparkContext.defaultParallelism) + 1))
    piece += piece % 2
    tasks = []
    for i, (p, size) in enumerate(zip(paths, sizes, strict=True)):
        borders = list(range(0, max(size, 1), piece))
        tasks += [{"file": i, "path": p, "start": a, "border": b, "sure": a == 0} for a, b in zip(borders, [*borders[1:], None], strict=True)]
    found = _job(spark, tasks, framing)
    by_file: list[list] = [[] for _ in paths]
    for t, f in zip(tasks, found, strict=True):
        by_file[t["file"]].append((t, f))
    _agree(spark, by_file, framing)
    return [_stitched(i, p, by_file[i]) for i, p in enumerate(paths)]


def _agree(spark: SparkSession, files: list[list[tuple[dict, dict]]], framing: Options) -> None:
    """Read pieces again, all that are wrong in one job, until each starts where the one before it stops.

    A piece that was read from a wrong guess mostly stops where it would from the right start, as chains meet after a few records.
    So where each piece before stops is taken as true for all pieces at once, and what was wrong everywhere is right after one more job. A piece whose
    stop changes makes the next one wrong, for the next job; the first wrong one is right for good each time, so this ends.
    """
    while True:
        wrong: list[tuple[list, int, int]] = []
        for parts in files:
            here = 0
            for k, (task, got) in enumerate(parts):
                if k and here >= (task["border"] or here + 1):
                    continue  # the piece before reaches beyond this one
                if k and (got["start"] != here or got.get("again")):
                    wrong.append((parts, k, here))
                if got["start"] < 0 or got["stop"] is None:
                    break
                here = got["stop"]
        if not wrong:
            return
        tasks = [parts[k][0] | {"start": here, "sure": True} for parts, k, here in wrong]
        for (parts, k, _), task, got in zip(wrong, tasks, _job(spark, tasks, framing), strict=True):
            parts[k] = task, got


def _stitched(index: int, path: str, parts: list[tuple[dict, dict]]) -> Surveyed:
    """Lead the true chain through the pieces of a file."""
    out = Surveyed([], {})
    carry, seq, here, lost, warnings, state = Carry(), 0, 0, 0, [], "complete"
    for k, (task, got) in enumerate(parts):
        if k and here >= (task["border"] or here + 1):
            continue  # the piece before reaches beyond this one
        s = got["status"]
        if got["start"] < 0:
            out.status = s
            out.pieces = [Piece(index, path, -1, None, s["ts_format"], 0, carry.packed(), json.dumps(s))]
            return out
        out.pieces.append(Piece(index, path, got["start"], got["stop"], got["ts_format"], seq, carry.packed(), zone=got["zone"]))
        first = got["first"]
        if first is not None:
            step = carry.now > NEVER and first["stamp"] < carry.now
            for at in ([seq + first["seq"]] if step else []) + ([seq + got["first_back"]] if got["first_back"] is not None else []):
                out.first_back = at if out.first_back is None else min(out.first_back, at)
            out.back += got["back"] + step
            out.first = out.first or first
        carry = carry.then(Carry.unpacked(got["carry"]))
        seq += got["records"] + got["resyncs"]
        out.accepted += got["accepted"]
        out.status["records"] = out.status.get("records", 0) + got["records"]
        lost += s["sync_losses"]
        warnings += s["warnings"]
        state = state if s["state"] == "complete" or s["state"] == "truncated-tail" and state != "complete" else s["state"]
        here = got["stop"]
        if here is None:
            break
    out.status = s | {"records": out.status["records"], "sync_losses": lost, "warnings": _few(warnings), "state": state}
    out.pieces[-1].status = json.dumps(out.status)
    return out


def _few(warnings: list[str]) -> list[str]:
    """The first losses of sync and all other warnings."""
    losses = [w for w in warnings if w.startswith("sync lost")]
    return losses[:MOST_TOLD] + [w for w in warnings if not w.startswith("sync lost")]


#: Bytes of a file up to which one task reads all its pieces, one after the other.
WHOLE = 4 << 20


def survey_file(index: int, path: str, framing: Options, piece: int) -> Surveyed:
    """What survey_files finds, of one file and in one task: each piece starts where the one before it stops, so none is guessed."""
    borders = list(range(0, max(os.path.getsize(path), 1), piece + piece % 2))
    parts: list[tuple[dict, dict]] = []
    here = 0
    for a, b in zip(borders, [*borders[1:], None], strict=True):
        if a and here >= (b or here + 1):
            continue  # the piece before reaches beyond this one
        got = survey(path, here, b, framing, True)
        parts.append(({"border": b}, got))
        if got["start"] < 0 or got["stop"] is None:
            break
        here = got["stop"]
    return _stitched(index, path, parts)


def few_tasks(spark: SparkSession, pieces: int, size: int) -> int:
    """Tasks for so many pieces of so many bytes in all: no more than there are pieces, and each with MOST_PIECE at most where pieces are small."""
    return max(1, min(pieces, max(2 * spark.sparkContext.defaultParallelism, size // MOST_PIECE + 1)))


def dealt(spark: SparkSession, files: list[tuple[int, str]], sizes: list[int]) -> DataFrame:
    """(i, path) of files in their order, many to a task."""
    n = few_tasks(spark, len(files), sum(sizes))
    listed = spark.createDataFrame([(k * n // len(files), i, p) for k, (i, p) in enumerate(files)], "task int, i int, path string")
    return listed.repartitionById(n, listed.task).select("i", "path")


def joined(found: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in found:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces_reader(select: Selection | None = None, **options) -> _Reader:
    return _Reader(_given(options) | {"pieces": "[]"} | ({"select": select.dumps()} if select else {}))


def read_files(spark: SparkSession, paths: list[str], piece: int, select: Selection | None = None, **options) -> DataFrame:
    """Raw rows of recordings by their pieces. Small files are surveyed and read where their task is, many to a task, so neither the driver nor the
    number of tasks grows with the number of pieces; those of over WHOLE bytes have a task for each piece."""
    check_inputs(paths)
    framing = framing_of(options)
    sizes = [os.path.getsize(p) for p in paths]
    small = [i for i, n in enumerate(sizes) if n <= WHOLE]
    large = [i for i, n in enumerate(sizes) if n > WHOLE]
    out: list[DataFrame] = []
    if small:
        reader = pieces_reader(select, **options)

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[pa.RecordBatch]:
                for b in found:
                    for i, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        for p in survey_file(i, path, framing, piece).pieces:
                            if reader._wanted(vars(p)):
                                yield from reader.read(_Part(vars(p)))

            yield from joined(rows())

        out.append(dealt(spark, [(i, paths[i]) for i in small], [sizes[i] for i in small]).mapInArrow(run, RAW))
    if large:
        found = zip(large, survey_files(spark, [paths[i] for i in large], framing, piece), strict=True)
        out.append(read_pieces(spark, [replace(p, file_index=i) for i, f in found for p in f.pieces], select, **options))
    return reduce(DataFrame.unionByName, out)


def check_inputs(paths: list[str]) -> None:
    for p in paths:
        if not os.path.exists(p):
            raise FileMissing(p)
        if not os.path.isfile(p):
            raise FileUnreadable(f"{p}: not a regular file")
        if not os.path.getsize(p):
            raise EmptyFile(p)


def _given(options: dict) -> dict[str, str]:
    return {k: str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else str(v) for k, v in options.items() if v is not None}


def framing_of(options: dict) -> Options:
    return _options(_given(options))[0]


def surveyed(spark: SparkSession, paths: list[str], **options) -> list[Surveyed]:
    check_inputs(paths)
    return survey_files(spark, list(paths), framing_of(options))


def read_pieces(spark: SparkSession, pieces: list[Piece], select: Selection | None = None, **options) -> DataFrame:
    """Raw rows of pieces, in their order; a task for each that may hold a record that is wanted."""
    spark.dataSource.register(RecordingSource)
    if select:
        options["select"] = select.dumps()
    return spark.read.format("recording").options(pieces=json.dumps([vars(p) for p in pieces]), **_given(options)).load()


def read_raw(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Raw rows of recordings, in files of a folder that all executors see."""
    return read_pieces(spark, [p for f in surveyed(spark, paths, **options) for p in f.pieces], **options)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def scan(spark: SparkSession, pieces: list[Piece], **options) -> DataFrame:
    """Raw rows with their message_type, bus, rt and subaddress as columns, to be filtered by.

    Where the session has PUSHDOWN on, plain filters on these columns, on stamp and on kind reach the source: pieces that can't hold what they ask for are
    not opened, and other records never become rows. Without it Spark filters, with the same result.
    """
    pushing = spark.conf.get(PUSHDOWN, "false").lower() == "true"
    return read_pieces(spark, pieces, keyed=True, pushing=pushing, **options)


def read_bytes(contents: DataFrame, **options) -> DataFrame:
    """The same from a table (file_index, name, content), such as the binaryFile source or a stream read to its end gives.

    For recordings in a store that only Spark reads, and for bytes without a file. name may be null, and then has no mux.
    """
    framing, mux = _options({k: str(v) for k, v in options.items() if v is not None})

    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for index, name, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                content = content or b""
                own = mux_of(name, **mux) if name is not None else mux["value"]
                yield from batches(Framer(lambda o, n, c=content: c[o : o + n], len(content), framing), index, name, own)

    def frame(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(rows(found))

    return contents.select("file_index", "name", "content").mapInArrow(frame, RAW)
