"""Which records are wanted, told to the source: pieces that can't hold any aren't opened, other records never become rows. No Spark here.

A zone says what a piece holds: the earliest and the latest stamp, and sets of bits of the values of each key. It may hold more than is there, never less.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, fields

import numpy as np

from ..schema import SPURIOUS_TYPE

KEYS = ("message_type", "bus", "rt", "subaddress")
#: The lists of message filters by the key that they look at.
LISTS = {"types": "message_type", "buses": "bus", "rts": "rt", "subaddresses": "subaddress"}
NONE = -1


def keys_of(type_word: np.ndarray, command: np.ndarray) -> dict[str, np.ndarray]:
    """The keys of records; spurious ones have neither terminal nor subaddress (NONE)."""
    tw, cmd = type_word.astype(np.int32), command.astype(np.int32)
    spurious = tw & 127 == SPURIOUS_TYPE
    return {"message_type": tw & 127, "bus": tw >> 7 & 1, "rt": np.where(spurious, NONE, cmd >> 11 & 31), "subaddress": np.where(spurious, NONE, cmd >> 5 & 31)}


@dataclass
class Zone:
    """What is known of the records of a piece. bare: some have no terminal, and none that they follow."""

    low: int | None = None
    high: int | None = None
    bits: dict[str, int] = field(default_factory=lambda: dict.fromkeys(KEYS, 0))
    bare: bool = False

    def add(self, stamp: np.ndarray, follows: np.ndarray, keys: dict[str, np.ndarray]) -> None:
        if not len(stamp):
            return
        low, high = int(stamp.min()), int(stamp.max())
        self.low = low if self.low is None else min(self.low, low)
        self.high = high if self.high is None else max(self.high, high)
        for k in KEYS:
            for v in np.unique(keys[k]).tolist():
                self.bits[k] |= 1 << v if v >= 0 else 0
        self.bare = self.bare or bool(((keys["rt"] == NONE) & ~follows).any())


@dataclass(frozen=True)
class Selection:
    """What is asked for. Everything that is given must hold.

    tests: (column, 'in' | 'not in' | '>=' | '<=', values), the column being a key, 'stamp', or 'time_us', which is the stamp where that is a calendar time
    and says nothing where it is a counter. What has no value in the column fails, markers too.
    lists: message filters (exclude_types, include_rts, ...): a continuation goes with the record that it follows, or for its own type.
    """

    tests: tuple[tuple[str, str, tuple[int, ...]], ...] = ()
    lists: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, filters=None, since_us: int | None = None, until_us: int | None = None) -> Selection:
        """That of message filters and of a range of time, its end left out."""
        lists = {f.name: tuple(v) for f in fields(filters) if (v := getattr(filters, f.name))} if filters is not None else {}
        tests = [("time_us", op, (v,)) for op, v in ((">=", since_us), ("<=", None if until_us is None else until_us - 1)) if v is not None]
        return cls(tuple(tests), lists)

    def __bool__(self) -> bool:
        return bool(self.tests or self.lists)

    def also(self, tests: Iterable[tuple[str, str, tuple[int, ...]]]) -> Selection:
        return Selection((*self.tests, *tests), self.lists)

    def dumps(self) -> str:
        return json.dumps([self.tests, self.lists])

    @classmethod
    def loads(cls, text: str | None) -> Selection:
        tests, lists = json.loads(text) if text else ((), {})
        return cls(tuple((c, op, tuple(v)) for c, op, v in tests), {k: tuple(v) for k, v in lists.items()})

    def may_hold(self, zone: Zone, ts_format: str) -> bool:
        """Whether a piece may hold a record that is wanted."""
        if zone.low is None:
            return False
        return all(_zone_passes(zone, ts_format, *t) for t in self.tests) and not any(_all_dropped(zone, name, values) for name, values in self.lists.items())

    def wanted(self, ts_format: str, stamp: np.ndarray, keys: dict[str, np.ndarray], follows: np.ndarray, parents: dict[str, np.ndarray]) -> np.ndarray:
        """Which of a block's records are wanted. parents: keys of those that the following ones follow."""
        keep = np.ones(len(stamp), bool)
        for column, op, values in self.tests:
            if column == "time_us" and ts_format != "irig":
                continue
            v = stamp if column in ("stamp", "time_us") else keys[column]
            there = True if column in ("stamp", "time_us") else v != NONE
            keep &= there & (np.isin(v, values) if op == "in" else ~np.isin(v, values) if op == "not in" else v >= values[0] if op == ">=" else v <= values[0])
        for name, values in self.lists.items():
            side, _, of = name.partition("_")
            v = keys[LISTS[of]]
            if of != "types" and len(parents["rt"]):
                v = v.copy()
                v[follows] = parents[LISTS[of]]
            found = np.isin(v, values)
            keep &= found if side == "include" else ~found
            if of == "types" and side == "exclude" and len(parents["rt"]):
                gone = np.zeros(len(stamp), bool)
                gone[follows] = np.isin(parents["message_type"], values)
                keep &= ~gone
        return keep


def _set(values: tuple[int, ...]) -> int:
    out = 0
    for v in values:
        out |= 1 << v if v >= 0 else 0
    return out


def _zone_passes(zone: Zone, ts_format: str, column: str, op: str, values: tuple[int, ...]) -> bool:
    if column in ("stamp", "time_us"):
        if column == "time_us" and ts_format != "irig":
            return True
        low, high = zone.low, zone.high
        if op == "in":
            return any(low <= v <= high for v in values)
        return not (low == high and low in values) if op == "not in" else high >= values[0] if op == ">=" else low <= values[0]
    bits = zone.bits[column]
    if op == "in":
        return bool(bits & _set(values))
    if op == "not in":
        return bool(bits & ~_set(values))
    return bool(bits >> max(values[0], 0)) if op == ">=" else values[0] >= 0 and bool(bits & ((1 << min(values[0], 62) + 1) - 1))


def _all_dropped(zone: Zone, name: str, values: tuple[int, ...]) -> bool:
    side, _, of = name.partition("_")
    bits = zone.bits[LISTS[of]]
    if side == "include":
        return not bits & _set(values)
    return not bits & ~_set(values) and not (zone.bare and of in ("rts", "subaddresses"))
