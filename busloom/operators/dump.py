"""Bytes and records of a file as text."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import EmptyFile, FileMissing, UsageError
from ..schema import MESSAGE_TYPES, SPURIOUS_TYPE
from ..sources.framing import TYPES

WIDTH = 16


def hex_lines(path: str, offset: int = 0, length: int | None = 256) -> Iterator[str]:
    """Lines of 16 bytes: offset, hexadecimal, printable characters. A range past the end is cut."""
    if offset < 0 or length is not None and length < 0:
        raise UsageError("offset and length can't be negative")
    if not os.path.exists(path):
        raise FileMissing(path)
    size = os.path.getsize(path)
    end = size if length is None else min(size, offset + length)
    with open(path, "rb") as f:
        f.seek(min(offset, size))
        for at in range(offset, end, WIDTH):
            raw = f.read(min(WIDTH, end - at))
            text = "".join(chr(b) if 32 <= b < 127 else "." for b in raw)
            yield f"{at:08X}  {raw.hex(' ').upper():<{3 * WIDTH - 1}}  |{text}|"


def record_lines(path: str, offset: int = 0, records: int | None = None) -> Iterator[str]:
    """A block of text for each record from offset on, as it stands in the file (calendar times assumed, no recovery).

    Stops at the terminator, at a length no record can have, at a record cut short, or after the given number of records.
    """
    if not os.path.exists(path):
        raise FileMissing(path)
    size = os.path.getsize(path)
    if not size:
        raise EmptyFile(path)
    with open(path, "rb") as f:

        def fetch(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        yield from _records(fetch, size, offset, records)


def lines_of(contents: DataFrame, offset: int = 0, records: int | None = None) -> DataFrame:
    """(file_index, number, line): the same of a table (file_index, name, content), such as the binaryFile source gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for index, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = content or b""
                lines = list(_records(lambda at, n, raw=raw: raw[at : at + n], len(raw), offset, records))
                yield pa.RecordBatch.from_arrays([pa.array([index] * len(lines), pa.int32()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], ["file_index", "number", "line"])

    return contents.select("file_index", "content").mapInArrow(run, "file_index int, number bigint, line string")


def _records(fetch: Callable[[int, int], bytes], size: int, offset: int, records: int | None) -> Iterator[str]:
    done = 0
    while offset + 2 <= size and (records is None or done < records):
        raw = fetch(offset, 126)
        word = lambda i, raw=raw: int.from_bytes(raw[2 * i : 2 * i + 2], "little")
        tw = word(0)
        if tw == 0:
            yield f"0x{offset:08X}: terminator"
            return
        count, kind = tw >> 8 & 63, tw & 127
        if count < 4:
            yield f"0x{offset:08X}: word count {count} is no record's (type word 0x{tw:04X}); stopping"
            return
        if offset + 2 * count > size:
            yield f"0x{offset:08X}: truncated, {2 * count} bytes declared and {size - offset} there"
            return
        name = MESSAGE_TYPES.get(kind, f"type 0x{kind:02X}") if kind in TYPES else f"type 0x{kind:02X}"
        flags = " ERROR" if tw >> 14 & 1 else ""
        yield f"0x{offset:08X}: {name} bus {'B' if tw >> 7 & 1 else 'A'} {count} words{flags} (type word 0x{tw:04X})"
        if count >= 4:
            up, mid, low = word(1), word(2), word(3)
            us = (mid & 15) << 16 | low
            free = " freerun" if up >> 15 else ""
            yield f"  time {up >> 5 & 511}:{up & 31:02d}:{mid >> 10:02d}:{mid >> 4 & 63:02d}.{us:06d}{free}"
        if count >= 5 and kind != SPURIOUS_TYPE:
            cmd = word(4)
            yield f"  command 0x{cmd:04X} rt {cmd >> 11} sa {cmd >> 5 & 31} {'T' if cmd >> 10 & 1 else 'R'} count {cmd & 31 or 32}"
        first = 4 if kind == SPURIOUS_TYPE else 5
        rest = [f"{word(i):04X}" for i in range(first, count)]
        for i in range(0, len(rest), 8):
            yield "  " + " ".join(rest[i : i + 8])
        offset += 2 * count
        done += 1
