"""Framing of a recording: which bytes are records. No Spark here.

A recording is a chain of records whose type word tells their length. What stands at each word is judged for a whole block at
once with numpy (type, length, time fields), and the chain is followed in many places of the block at the same time: chains that
start anywhere meet the true one within a few records, so only the pieces before they meet are followed one by one. Blocks are
bounded, so memory does not grow with the file. A framer may also start at a known record in the midst of a file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

TYPES = (0x01, 0x02, 0x04, 0x08, 0x10, 0x18, 0x20)
SCAN_BYTES = 64 * 1024
BLOCK_BYTES = 4 << 20
#: Bytes that a decision may look ahead beyond a scan: the longest record for each of the most look-ahead records, and more.
REACH = 64 * 126 + 4096
AFTER_END_BYTES = 1 << 20
#: Losses of sync that are told in words; the others are counted.
MOST_TOLD = 8
#: Words of a lane, and blocks so small that there is only one.
LANE, SMALL = 512, 8192
_KNOWN = np.zeros(1 << 16, bool)
for _t in TYPES:
    _KNOWN[_t :: 128] = True

OK, UNREADABLE, UNKNOWN_TYPE, BAD_COUNT, TRUNCATED, BAD_TIME = range(6)
REASONS = ("valid", "type word unreadable", "unknown message type", "word count out of range", "record runs past the end", "time field out of range")


@dataclass(frozen=True)
class Options:
    input_time_format: str = "auto"
    strict: bool = False
    detect_records: int = 8
    lookahead_records: int = 2

    def __post_init__(self) -> None:
        if self.input_time_format not in ("auto", "irig", "standard"):
            raise ValueError(f"input_time_format: {self.input_time_format!r}")
        if not 1 <= self.detect_records <= 32 or not 1 <= self.lookahead_records <= 32:
            raise ValueError("detect_records and lookahead_records: 1 to 32")


@dataclass
class Status:
    """How a file ended. state: complete, empty-recording, partial-recovered, truncated-tail, or the name of an error."""

    state: str = "complete"
    records: int = 0
    sync_losses: int = 0
    ts_format: str = "irig"
    stop_offset: int = 0
    detail: str = ""
    warnings: list[str] = field(default_factory=list)

    def lost(self, text: str) -> None:
        """Count a loss of sync, and tell the first few."""
        self.sync_losses += 1
        if self.sync_losses <= MOST_TOLD:
            self.warnings.append(text)


@dataclass
class Records:
    """Records of one block: byte offsets, and their words one after the other."""

    offsets: np.ndarray
    counts: np.ndarray
    words: np.ndarray

    def upto(self, n: int) -> Records:
        return Records(self.offsets[:n], self.counts[:n], self.words[: int(self.counts[:n].sum())])

    def behind(self, n: int) -> Records:
        return Records(self.offsets[n:], self.counts[n:], self.words[int(self.counts[:n].sum()) :])


@dataclass
class Resync:
    offset: int
    resumed: int
    reason: str


def _times_ok(up: np.ndarray, mid: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether the fields of calendar times are in range; a clock that runs free has any day."""
    day = (up >> 5) & 511
    return ((up & 31) < 24) & ((mid >> 10) < 60) & (((mid >> 4) & 63) < 60) & (((mid & 15) << 16 | low) <= 999_999) & ((up >= 0x8000) | ((day >= 1) & (day <= 366)))


def follow(ok: np.ndarray, step: np.ndarray, at: int, stop: int) -> tuple[np.ndarray, int]:
    """The places of the chain from at on that are ok and before stop, and the place where it leaves. step leads from each to the next.

    Every lane of LANE words is followed from its first likely word, all lanes at once, and again from the next one where a chain
    breaks off; then the true chain is led through the lanes. Where it meets a place that its lane has seen, the rest of the lane is known.
    """
    stop = min(stop, len(ok))
    if stop - at < SMALL:
        fine, length, out = ok[at:stop].tolist(), step[at:stop].tolist(), []
        i, n = 0, stop - at
        while i < n and fine[i]:
            out.append(at + i)
            i += length[i]
        return np.array(out, np.int64), at + max(i, 0)
    first = np.arange(at, stop, LANE)
    end = np.minimum(first + LANE, stop)
    likely = np.concatenate([np.flatnonzero(ok[at:stop]) + at, [stop]])
    begin = likely[np.searchsorted(likely, first)]
    place, lane = begin.copy(), np.arange(len(first))
    while len(lane):  # where the last chain of each lane begins
        place, lane = place[go := place < end[lane]], lane[go]
        going = ok[place]
        if not going.all():
            broken = np.flatnonzero(~going)
            place[broken] = begin[lane[broken]] = likely[np.searchsorted(likely, place[broken])]
            continue
        place = place + step[place]
    seen = np.zeros(stop, bool)
    place, lane = begin.copy(), np.arange(len(first))
    leave = np.maximum(begin, end)
    while len(lane):
        place, lane = place[go := place < end[lane]], lane[go]
        seen[place] = True
        place = place + step[place]
        leave[lane] = place
    here, own = at, []
    for lo, hi, away in zip(first.tolist(), end.tolist(), leave.tolist(), strict=True):
        if here >= hi:
            seen[lo:hi] = False
            continue
        while here < hi and not seen[here] and ok[here]:
            own.append(here)
            here += int(step[here])
        if here < hi and seen[here]:
            seen[lo:here] = False
            here = away
        else:
            seen[lo:hi] = False
        if here < hi:  # no record stands there
            seen[hi:] = False
            break
    seen[own] = True
    return np.flatnonzero(seen[at:]) + at, here


class _Block:
    """Words of a file from base on, with what is known of a record at each of them."""

    def __init__(self, base: int, raw: bytes, size: int) -> None:
        self.base, self.size = base, size
        self.words = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2")
        self.end = base + len(raw)
        self.count = ((self.words >> 8) & 63).astype(np.int32)
        self.told: dict[str | None, np.ndarray] = {}

    def verdicts(self, ts: str | None) -> np.ndarray:
        """For each word, why no record of a time format starts there, or OK; followers are not looked at."""
        if ts not in self.told:
            w, least = self.words, 5 if ts == "irig" else 4
            out = np.full(len(w), UNKNOWN_TYPE, np.int8)
            at = np.flatnonzero(_KNOWN[w])
            n = self.count[at]
            late = OK
            if ts == "irig":
                timed = at + 3 < len(w)
                where = np.where(timed, at, 0)
                fields = [w[np.minimum(where + k, len(w) - 1)].astype(np.int32) for k in (1, 2, 3)]
                late = np.where(timed & ~_times_ok(*fields), BAD_TIME, OK)
            out[at] = np.where(n < least, BAD_COUNT, np.where(self.base + 2 * (at + n) > self.size, TRUNCATED, late))
            self.told[ts] = out
        return self.told[ts]

    def plausible(self, at: np.ndarray, ts: str | None, depth: int, honour_end: bool) -> np.ndarray:
        """Whether records may start at some words, judging depth records from each on."""
        fine = self.verdicts(ts)[at] == OK
        w, least = self.words, 5 if ts == "irig" else 4
        near = at + self.count[at]
        open_ = fine.copy()
        for _ in range(1, depth):
            open_ &= (near < len(w)) & (self.base + 2 * near + 2 <= self.size)
            if not open_.any():
                break
            there = np.where(open_, near, 0)
            ends = (w[there] == 0) & (honour_end | (self.base + 2 * there + 2 == self.size))
            open_ &= ~ends
            good = _KNOWN[w[there]] & (self.count[there] >= least)
            fine &= good | ~open_
            open_ &= good
            near = np.where(open_, near + self.count[there], near)
        return fine

    def why_not(self, at: int, ts: str | None) -> int:
        return int(self.verdicts(ts)[at]) if at < len(self.words) else UNREADABLE

    def find(self, start: int, stop: int, ts: str | None, depth: int, honour_end: bool) -> int | None:
        """The first word from start to stop at which a record is valid."""
        likely = np.flatnonzero(self.verdicts(ts)[start : min(stop, len(self.words))] == OK) + start
        found = likely[self.plausible(likely, ts, depth, honour_end)]
        return int(found[0]) if len(found) else None


def probe(block: _Block, at: int, most: int) -> tuple[str, str, int, int, int]:
    """Time format, confidence, both scores and the records probed, from the records at word at and after it."""
    w, reach = block.words, len(block.words) - (1 if block.end - block.base < 2 else 0)
    starts: list[int] = []
    while len(starts) < max(1, most) and at + 4 <= reach and block.count[at] >= 4:
        starts.append(at)
        at += int(block.count[at])
    i = np.array(starts, np.int64)
    kind, count = w[i] & 127, block.count[i]
    scores = []
    for ts_words in (3, 2):
        there = i + 1 + ts_words < len(w)
        cmd = w[np.where(there, i + 1 + ts_words, 0)].astype(np.int32)
        transmit, length = cmd >> 10 & 1, np.where(cmd & 31, cmd & 31, 32)
        own = 2 * np.where(transmit == 1, kind == 0x04, kind == 0x02) + 2 * (count - 3 - ts_words == length)
        if ts_words == 3:
            up, mid = (w[np.minimum(i + k, len(w) - 1)].astype(np.int32) for k in (1, 2))
            own = own + (((up & 31) < 24) & ((mid >> 10) < 60) & (((mid >> 4) & 63) < 60))
        scores.append(int(own[there].sum()))
    irig, standard = scores
    high, margin = max(scores), abs(irig - standard)
    sure = "ambiguous" if high < 4 or margin < 3 else "decisive" if high >= 8 and margin >= 6 else "marginal"
    return ("irig" if irig >= standard else "standard"), sure, irig, standard, len(starts)


def _first_cut_short(block: _Block, ts: str | None, stop: int) -> tuple[int, int, int] | None:
    least = 4 if ts == "standard" else 5
    at = np.flatnonzero(_KNOWN[block.words[:stop]] & (block.count[:stop] >= least))
    at = at[block.base + 2 * (at + block.count[at]) > block.size]
    return (2 * int(at[0]), 2 * int(block.count[at[0]]), block.size - 2 * int(at[0])) if len(at) else None


class Framer:
    """Iterates over Records and Resync of one file; status holds how it ended.

    With start (the offset of a record) and the time format, what is before start is left out, and the head isn't judged.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int, options: Options | None = None, block_bytes: int = BLOCK_BYTES, start: int | None = None, ts_format: str = "irig") -> None:
        self.read, self.size, self.options = read, size, options or Options()
        self.block_bytes = max(block_bytes, 2 * (SCAN_BYTES + REACH))
        self.status = Status(ts_format=ts_format)
        self.start = start
        self.why = ""  # of the last loss of sync

    def head(self) -> int | None:
        """The offset of the first record, with the time format resolved; None if there is none or the file is refused."""
        if not self.size:
            self._fail("EmptyFile", "the file has no bytes")
            return None
        at = self._start(_Block(0, self.read(0, min(self.block_bytes, SCAN_BYTES + REACH)), self.size))
        return None if at is None else 2 * at

    def resume(self, offset: int, depth: int) -> int | None:
        """The offset of what looks like a record from an offset (even) on, judging depth records."""
        block = _Block(offset, self.read(offset, SCAN_BYTES + REACH), self.size)
        hit = block.find(0, SCAN_BYTES // 2, self.status.ts_format, depth, False)
        return None if hit is None else offset + 2 * hit

    def _fail(self, name: str, detail: str, offset: int = 0) -> None:
        self.status.state, self.status.detail, self.status.stop_offset = name, detail, offset

    def _start(self, block: _Block) -> int | None:
        """The word of the first record, with the time format resolved; None if there is none or the file is refused."""
        o, s = self.options, self.status
        hint = None if o.input_time_format == "auto" else o.input_time_format
        limit = SCAN_BYTES // 2
        first = block.find(0, limit, hint, o.lookahead_records, True)
        s.ts_format = hint or "irig"
        if first is None:
            if len(block.words) and block.words[0] == 0:
                s.state = "empty-recording"
                s.warnings.append("the stream opens on its terminator: no records")
                self._after_end(0)
                return None
            cut = _first_cut_short(block, hint, limit)
            if cut and o.strict:
                self._fail("FirstRecordTruncated", f"first record at 0x{cut[0]:X} declares {cut[1]} bytes, {cut[2]} are there", cut[0])
            else:
                why = f"first record at 0x{cut[0]:X} is truncated" if cut else "nothing looks like a record"
                self._fail("NoValidRecords", f"{why} in the first {min(self.size, SCAN_BYTES)} bytes")
            return None
        length = int(block.count[first])
        sample = block.words[first : first + 4 * length]
        if len(sample) == 4 * length and (sample.reshape(4, length) == sample[:length]).all():
            self._fail("HomogeneousPayload", f"the first records at 0x{2 * first:X} are byte for byte the same: not a recording", 2 * first)
            return None
        fmt, sure, irig, standard, n = probe(block, first, o.detect_records)
        told = f"irig={irig} standard={standard} over {n} record(s)"
        if hint is None:
            s.ts_format = fmt
            if sure == "ambiguous":
                if o.strict:
                    self._fail("TimestampFormatMismatch", f"the time format is ambiguous at 0x{2 * first:X}: {told}", 2 * first)
                    return None
                s.warnings.append(f"the time format is ambiguous ({told}); {fmt} is a guess")
        elif sure == "decisive" and fmt != hint:
            if o.strict:
                self._fail("TimestampFormatMismatch", f"{hint} was asked for, but {fmt} is decisive at 0x{2 * first:X}: {told}", 2 * first)
                return None
            s.warnings.append(f"{hint} was asked for, but {fmt} is decisive: {told}")
        return first

    def _after_end(self, terminator: int) -> None:
        pos = terminator + 2
        while pos < min(self.size, terminator + 2 + AFTER_END_BYTES):
            raw = self.read(pos, min(SCAN_BYTES, terminator + 2 + AFTER_END_BYTES - pos))
            if not raw:
                return
            left = raw.lstrip(b"\0")
            if left:
                self.status.warnings.append(f"data after the terminator at 0x{terminator:X} isn't decoded (first at 0x{pos + len(raw) - len(left):X})")
                return
            pos += len(raw)

    def __iter__(self) -> Iterator[Records | Resync]:
        s, o = self.status, self.options
        if self.start is None:
            self.start = self.head()
            if self.start is None:
                return
        ts = s.ts_format
        block = _Block(self.start, self.read(self.start, self.block_bytes), self.size)
        at = 0
        ok = block.verdicts(ts) == OK

        def taken(idx: np.ndarray) -> Records:
            n = block.count[idx].astype(np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            s.records += len(idx)
            return Records(block.base + 2 * idx, n, block.words[np.repeat(idx - first[:-1], n) + np.arange(first[-1])])

        while True:
            last = block.end >= self.size
            # while nothing but records comes, stay away from the end of the block, so that every decision sees all it needs
            stop = len(block.words) if last else len(block.words) - (SCAN_BYTES + REACH) // 2
            starts, at = follow(ok, block.count, at, stop)
            if len(starts):
                yield taken(starts)
            if at >= stop and not last:
                offset = block.base + 2 * at
                block = _Block(offset, self.read(offset, self.block_bytes), self.size)
                ok = block.verdicts(ts) == OK
                at = 0
                continue
            offset = block.base + 2 * at
            s.stop_offset = offset
            raw = int(block.words[at]) if at < len(block.words) else None
            if self.size - offset < 8 and not (o.strict and raw):
                if raw:
                    s.state = "truncated-tail" if s.state == "complete" else s.state
                    s.warnings.append(f"{self.size - offset} trailing byte(s) at 0x{offset:X} hold no whole record")
                elif raw == 0:
                    self._after_end(offset)
                return
            if raw is None:
                return
            if raw == 0:
                self._after_end(offset)
                return
            why = block.why_not(at, ts)
            if o.strict:
                s.sync_losses += 1
                name = {UNKNOWN_TYPE: "UnknownTypeWord", BAD_COUNT: "InvalidTypeWord", TRUNCATED: "RecordTruncated"}.get(why, "PayloadError")
                self._fail(name, f"{REASONS[why]} at 0x{offset:X} (type word 0x{raw:04X})", offset)
                return
            hit = block.find(at + 1, at + SCAN_BYTES // 2, ts, o.lookahead_records, False)
            if hit is None and why == TRUNCATED:
                s.state = "truncated-tail" if s.state == "complete" else s.state
                s.warnings.append(f"{self.size - offset} trailing byte(s) at 0x{offset:X} hold no whole record")
                return
            self.why = REASONS[why]
            s.lost(f"sync lost at 0x{offset:X}: {REASONS[why]}")
            s.state = "partial-recovered"
            if hit is None:
                if self.size - offset >= SCAN_BYTES:
                    self._fail("UnrecoverableSyncLoss", f"no record within {SCAN_BYTES} bytes of 0x{offset:X}", offset)
                return
            yield Resync(offset, block.base + 2 * hit, REASONS[why])
            at = hit
