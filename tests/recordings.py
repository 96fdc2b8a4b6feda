"""Recordings made for tests, and a model that reads them one record at a time."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

CODES = {"receive": 0x02, "transmit": 0x04, "rt2rt": 0x08, "bcast": 0x10, "rt2rt_bcast": 0x18, "mode": 0x01, "spurious": 0x20}


def pack(*words: int) -> bytes:
    return b"".join((w & 0xFFFF).to_bytes(2, "little") for w in words)


def irig(us: int, day: int = 10, free: bool = False) -> list[int]:
    s, micros = divmod(us, 1_000_000)
    h, m, s = s // 3600 % 24, s // 60 % 60, s % 60
    return [free << 15 | day << 5 | h, m << 10 | s << 4 | micros >> 16, micros & 0xFFFF]


def standard(ticks: int) -> list[int]:
    return [ticks >> 16, ticks & 0xFFFF]


def command(rt: int, sa: int, transmit: int, count: int) -> int:
    return rt << 11 | transmit << 10 | sa << 5 | count % 32


def record(kind: str, stamp: list[int], rt: int = 1, sa: int = 2, n: int = 2, bus: int = 0, error: int | None = None, transmit: int | None = None, data: list[int] | None = None, status: int | None = None, reserved: int = 0) -> bytes:
    data = list(range(100, 100 + n)) if data is None else data
    status = rt << 11 if status is None else status
    if kind == "spurious":
        body = data
    else:
        t = {"receive": 0, "transmit": 1, "rt2rt": 1, "bcast": 0, "rt2rt_bcast": 1, "mode": 0}[kind] if transmit is None else transmit
        cmd = command(31 if kind == "bcast" else rt, sa, t, n)
        if error is not None:
            body = [cmd, *data, error]
        else:
            second = command(rt + 1 & 31, sa, 0, n)
            body = {
                "receive": [cmd, *data, status], "transmit": [cmd, status, *data], "bcast": [cmd, *data], "rt2rt": [cmd, second, status, *data, (rt + 1 & 31) << 11],
                "rt2rt_bcast": [cmd, second, status, *data], "mode": [cmd, status, *data] if t else [cmd, *data, status],
            }[kind]
    words = 1 + len(stamp) + len(body)
    return pack(CODES[kind] | bus << 7 | words << 8 | (error is not None) << 14 | reserved << 15, *stamp, *body)


END = pack(0)


def random_recording(seed: int, records: int = 60, damage: int = 0, start: int = 0) -> bytes:
    """A chain of records of all kinds, some with errors and continuations, some hit by damage."""
    r = random.Random(seed)
    out, us = [], start or r.randrange(10**9)
    for _ in range(records):
        us += r.choice([0, 0, 20, 150, 300]) if r.random() > 0.03 else -100
        us = max(us, 0)
        kind = r.choices(list(CODES), [40, 30, 8, 4, 3, 8, 7])[0]
        rt, sa, n = r.randrange(0, 31), r.randrange(1, 31), r.randrange(1, 33)
        if kind == "mode":
            sa, n = r.choice([0, 31]), r.randrange(0, 2)
            out.append(record(kind, irig(us), r.choice([rt, 31]), sa, n, r.randrange(2), transmit=r.randrange(2)))
        elif kind != "spurious" and r.random() < 0.15:
            out.append(record(kind, irig(us), rt, sa, min(n, 20), r.randrange(2), error=r.choice([0x0120, 0x0140, 0x0999])))
            if r.random() < 0.6:
                out.append(record("spurious", irig(us + 5), n=r.randrange(1, 5)))
        else:
            wrong = r.randrange(2) if r.random() < 0.05 and kind in ("receive", "transmit") else None
            out.append(record(kind, irig(us), rt, sa, n, r.randrange(2), transmit=wrong, status=r.choice([None, None, None, 7 << 11]) if kind != "bcast" else None))
    raw = bytearray(b"".join(out) + END)
    for _ in range(damage):
        at = r.randrange(len(raw))
        what = r.random()
        if what < 0.5:
            raw[at] ^= 1 << r.randrange(8)
        elif what < 0.75:
            raw[at:at] = bytes(r.randrange(256) for _ in range(2 * r.randrange(1, 6)))
        else:
            del raw[at : at + 2 * r.randrange(1, 6)]
    return bytes(raw)


@dataclass
class Read:
    rows: list[dict] = field(default_factory=list)
    sync_losses: int = 0
    state: str = "complete"


def _valid(raw: bytes, at: int, fmt: str | None, depth: int, end_ok: bool) -> str | None:
    word = lambda o: int.from_bytes(raw[o : o + 2], "little") if 0 <= o and o + 2 <= len(raw) else None
    least = 5 if fmt == "irig" else 4
    tw = word(at)
    if tw is None:
        return "unreadable"
    if tw & 127 not in CODES.values():
        return "type"
    n = tw >> 8 & 63
    if n < least:
        return "count"
    if at + 2 * n > len(raw):
        return "truncated"
    if fmt == "irig" and at + 8 <= len(raw):
        u, m, low = word(at + 2), word(at + 4), word(at + 6)
        if u & 31 > 23 or m >> 10 > 59 or m >> 4 & 63 > 59 or (m & 15) << 16 | low > 999_999 or not u >> 15 and not 1 <= u >> 5 & 511 <= 366:
            return "time"
    nxt = at + 2 * n
    for _ in range(1, depth):
        w = word(nxt)
        if w is None or w == 0 and (end_ok or nxt + 2 == len(raw)):
            break
        if w & 127 not in CODES.values() or (w >> 8 & 63) < least:
            return "follower"
        nxt += 2 * (w >> 8 & 63)
    return None


def read_irig(raw: bytes, depth: int = 2) -> Read:
    """Sequential model of lenient reading, for a recording whose times are known to be calendar times."""
    out = Read()
    at = next((o for o in range(0, min(len(raw), 65536), 2) if _valid(raw, o, "irig", depth, True) is None), None)
    if at is None:
        out.state = "empty-recording" if raw[:2] == b"\0\0" else "NoValidRecords"
        return out
    parent = None
    clock: dict[tuple, int] = {}
    word = lambda o: int.from_bytes(raw[o : o + 2], "little")
    while True:
        if len(raw) - at < 8:
            break
        tw = word(at)
        if tw == 0:
            break
        why = _valid(raw, at, "irig", 1, True)
        if why:
            hit = next((o for o in range(at + 2, min(len(raw), at + 65536), 2) if _valid(raw, o, "irig", depth, False) is None), None)
            if hit is None and why == "truncated":
                break
            out.sync_losses += 1
            if hit is None:
                break
            at, parent = hit, None
            continue
        n, kind, err = tw >> 8 & 63, tw & 127, tw >> 14 & 1
        u, m, low = word(at + 2), word(at + 4), word(at + 6)
        us = ((u >> 5 & 511) * 86400 + (u & 31) * 3600 + (m >> 10) * 60 + (m >> 4 & 63)) * 1_000_000 + ((m & 15) << 16 | low)
        body = [word(at + 8 + 2 * i) for i in range(n - 4)]
        row = {"file_offset": at, "message_type": kind, "time_us": us, "rt": None, "data_words": [], "error_word": None, "status_word": None, "status_word_2": None, "command_word_2": None, "delta_us": None, "message_format": 11}
        at += 2 * n
        if kind == 0x20:
            row |= {"data_words": body[:32], "error_word": 0x2001 if parent is None else 0x2000, "time_us": us if parent is None else parent}
            parent = None
            out.rows.append(row)
            continue
        cmd = body[0]
        rt, t, sa, c = cmd >> 11, cmd >> 10 & 1, cmd >> 5 & 31, cmd & 31 or 32
        fmt = {2: 1, 4: 2, 8: 3, 16: 4, 24: 5}.get(kind) or ((10 if n >= 6 else 9) if rt == 31 else ((6 if t else 7) if n >= 7 else 8))
        row |= {"rt": rt, "subaddress": sa, "direction": t, "message_format": fmt}
        if err:
            if n < 6:
                parent = None
                continue
            row |= {"data_words": body[1:-1][:32], "error_word": body[-1]}
        else:
            need = {1: c + 1, 2: c + 1, 3: c + 3, 4: c, 5: c + 2, 6: 2, 7: 2, 8: 1, 9: 0, 10: 1}[fmt]
            if kind == 2 and t or kind == 4 and not t or n < 5 + need:
                parent = None
                continue
            c2 = body[1] if fmt in (3, 5) and len(body) > 1 else None
            if c2 is not None and (c2 >> 10 & 1 or (c2 & 31 or 32) != c):
                parent = None
                continue
            get = lambda i: body[i] if i < len(body) else None
            row |= {
                1: lambda: {"data_words": body[1 : 1 + c], "status_word": get(1 + c)}, 2: lambda: {"status_word": get(1), "data_words": body[2 : 2 + c]},
                3: lambda: {"command_word_2": c2, "status_word": get(2), "data_words": body[3 : 3 + c], "status_word_2": get(3 + c)}, 4: lambda: {"data_words": body[1 : 1 + c]},
                5: lambda: {"command_word_2": c2, "status_word": get(2), "data_words": body[3 : 3 + c]}, 6: lambda: {"status_word": get(1), "data_words": body[2:3]},
                7: lambda: {"data_words": body[1:2], "status_word": get(2)}, 8: lambda: {"status_word": get(1)}, 9: dict, 10: lambda: {"data_words": body[1:2]},
            }[fmt]()
        key = (rt, sa, t)
        row["delta_us"] = 0 if key not in clock else us - clock[key] if us >= clock[key] else None
        clock[key] = us
        parent = us if err else None
        out.rows.append(row)
    return out
