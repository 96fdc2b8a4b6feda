"""The 'growing_recording' stream source: rows of recordings while they are being written.

An offset tells for each file where its next record stands, the number of its next row, and what the records before leave to it. Rows come
once what is there decides them for good: a record when all its words are there; a loss of sync, and the first record, when enough follows that no later
byte could change where reading goes on. So whatever the steps in which a file has grown, its rows are those of the whole, and what the
source tells of earlier records (parents, gaps, highest times) needs no state of the query.

The driver frames what has come since the last offset, and makes no rows; tasks make them, one for each stretch. A query that starts, or starts
again after all its batches were done, frames what is there once from the beginning.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import UsageError
from ..schema import RAW
from .facts import Carry, facts
from .framing import BLOCK_BYTES, REACH, SCAN_BYTES, Framer, Options, Resync
from .inputs import MAX_FILES, mux_of
from .recording import _given, _opened, _options, _Part, batches

#: Bytes of a file that a batch takes and that a task reads; both end with a block.
MOST, STRETCH = 256 << 20, 32 << 20
#: The offset of a file that nothing is known of.
NEW = {"at": None, "seq": 0, "ts_format": "irig", "carry": None, "done": False, "state": "complete", "detail": ""}


def advance(fetch, size: int, known: dict, framing: Options, most: int | None = None, ended: bool = False, stretch: int = STRETCH) -> tuple[dict, list[dict]]:
    """The offset of a file with so many bytes, known being the one before; and offsets on the way, a stretch apart.

    ended: the file grows no more, so its end is judged as that of any file. most: bytes after which to stop for now.
    """
    if known["done"]:
        return known, []
    if known["at"] is None:
        head = Framer(fetch, size, framing)
        first = head.head()
        if not ended and (size < SCAN_BYTES + REACH if first is None else size - first < REACH):
            return known, []
        told = {"state": head.status.state, "detail": head.status.detail}
        if first is None:
            return known | {"done": True} | told, []
        known = known | {"at": first, "ts_format": head.status.ts_format, "carry": Carry().packed()}
    begin, seq, carry, gap, marks = known["at"], known["seq"], Carry.unpacked(known["carry"]), False, []
    here = marked = begin
    framer = Framer(fetch, size, framing, min(BLOCK_BYTES, max(size - begin, 1)), begin, known["ts_format"])
    width = 3 if known["ts_format"] == "irig" else 2
    so_far = lambda **more: known | {"at": here, "seq": seq, "carry": carry.packed()} | more
    for item in framer:
        if isinstance(item, Resync):
            if not ended and size - item.resumed < REACH:
                return so_far(), marks
            seq, gap = seq + 1, True
            continue
        facts(item.counts, item.words, width, carry, gap)
        seq, gap = seq + len(item.offsets), False
        here = int(item.offsets[-1] + 2 * item.counts[-1])
        if most is not None and here - begin >= most:
            return so_far(), marks
        if here - marked >= stretch:
            marks.append(so_far())
            marked = here
    stop = framer.status.stop_offset
    lost = framer.status.state == "UnrecoverableSyncLoss" and (ended or size - stop >= SCAN_BYTES + REACH)
    over = size - stop >= 2 and fetch(stop, 2) == b"\0\0"
    if lost or over or ended:
        return so_far(done=True, state=framer.status.state if lost or ended else "complete", detail=framer.status.detail), marks
    return so_far(), marks


class _Growing(DataSourceStreamReader):
    def __init__(self, given: dict[str, str]) -> None:
        self.framing, self.mux = _options(given)
        if self.framing.strict:
            raise UsageError("a recording that grows is read leniently")
        self.paths = json.loads(given["paths"])
        if len(self.paths) > MAX_FILES:
            raise UsageError(f"{len(self.paths)} inputs; {MAX_FILES} at most")
        self.ended = given.get("ended") == "true"
        self.most = int(given.get("most_bytes", MOST))
        self.now: dict[str, dict] = {}
        self.marks: dict[str, list[dict]] = {p: [] for p in self.paths}

    def initialOffset(self) -> dict:
        return {p: dict(NEW) for p in self.paths}

    def latestOffset(self) -> dict:
        # without a known offset a bound might end before what an earlier run has given
        self.now = {p: self._advanced(p, self.now.get(p, NEW), self.most if p in self.now else None) for p in self.paths}
        return self.now

    def _advanced(self, path: str, known: dict, most: int | None) -> dict:
        if known["done"] or not os.path.exists(path):
            return known
        with _opened(path) as (fetch, size):
            if not size and not self.ended:
                return known
            got, marks = advance(fetch, size, known, self.framing, most, self.ended)
        self.marks[path] += marks
        return got

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not self.now:  # a batch of an earlier run is done again
            self.now = end
        out: list[InputPartition] = []
        for i, p in enumerate(self.paths):
            a, b = start.get(p, NEW), end.get(p, NEW)
            if b["at"] is None or a["at"] is not None and a["at"] >= b["at"]:
                continue
            if a["at"] is None:
                a = b | {"at": -1, "seq": 0, "carry": Carry().packed()}
            stops = [m for m in self.marks[p] if a["at"] < m["at"] < b["at"]] + [b]
            for stop in stops:
                out.append(_Part({"file_index": i, "path": p, "start": a["at"], "stop": stop["at"], "ts_format": b["ts_format"], "seq": a["seq"], "carry": a["carry"]}))
                a = stop
        return out

    def commit(self, end: dict) -> None:
        for p in self.paths:
            at = end.get(p, NEW)["at"]
            self.marks[p] = [m for m in self.marks[p] if at is None or m["at"] > at]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        p = part.piece
        with _opened(p["path"]) as (fetch, size):
            start = p["start"] if p["start"] >= 0 else Framer(fetch, size, self.framing).head()
            framer = Framer(fetch, size, self.framing, min(BLOCK_BYTES, max(p["stop"] - start, 1)), start, p["ts_format"])
            yield from batches(framer, p["file_index"], p["path"], mux_of(p["path"], **self.mux), p["seq"], Carry.unpacked(p["carry"]), p["stop"], None)


class GrowingSource(DataSource):
    """spark.readStream.format('growing_recording'): option paths (a JSON list), ended, most_bytes, and those of reading."""

    @classmethod
    def name(cls) -> str:
        return "growing_recording"

    def schema(self):
        return RAW

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Growing(dict(self.options))


def read_growing(spark: SparkSession, paths: list[str], ended: bool = False, **options) -> DataFrame:
    """A stream of raw rows of recordings that grow, in a folder that all machines see; files may still be missing. There are no status rows.

    ended: they grow no more. A query that is started again with it, from its checkpoint, gives what was still open at their ends.
    """
    spark.dataSource.register(GrowingSource)
    return spark.readStream.format("growing_recording").options(paths=json.dumps(paths), ended=str(ended).lower(), **_given(options)).load()
