"""What is known of a record from those before it in its file. No Spark here.

A framer reads records in their order of arrival, so it can tell for each what a window over the file would: whether it continues
the errored record right before it, when its key was last seen, how late the file's clock has been, and whether time steps back.
These come as columns of the raw rows, and decoding needs no window and no shuffle. Records are judged for a block at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..schema import SPURIOUS_TYPE

KEYS = 1 << 11
#: Below all stamps.
NEVER = -(1 << 62)


def rejected(first: np.ndarray, count: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Whether decoding rejects each record: the counterpart, on arrays of words, of operators.decode.reject_reason."""
    tw = words[first].astype(np.int32)
    code, error = tw & 127, (tw >> 14 & 1) == 1
    there = lambda k: np.where(count > 1 + width + k, words[np.minimum(first + 1 + width + k, len(words) - 1)], 0).astype(np.int32)
    cmd, second = there(0), there(1)
    declared, declared2 = (np.where(c & 31, c & 31, 32) for c in (cmd, second))
    rt, direction = cmd >> 11 & 31, cmd >> 10 & 1
    pair = (code == 0x08) | (code == 0x18)
    room = count - width - 2
    mode = np.where(rt == 31, room >= 1, np.where(room >= 2, 2, 1))
    need = np.select([code == 0x01, (code == 0x02) | (code == 0x04), code == 0x08, code == 0x10, code == 0x18], [mode, declared + 1, declared + 3, declared, declared + 2], 0)
    plain = ((code == 0x02) & (direction == 1)) | ((code == 0x04) & (direction == 0)) | (room < need) | pair & ((second >> 10 & 1 == 1) | (declared != declared2))
    return (code != SPURIOUS_TYPE) & np.where(error, count < width + 3, plain)


@dataclass
class Carry:
    """What a block leaves to the next: the last row, the highest and the last stamp, and the last stamp of each key."""

    opens: bool = False
    parent: list[int] = field(default_factory=list)
    stamp: int = NEVER
    high: int = NEVER
    now: int = NEVER
    keys: np.ndarray = field(default_factory=lambda: np.full(KEYS, NEVER, np.int64))

    def then(self, later: Carry) -> Carry:
        """What both leave, one after the other; later was made without knowing of this one, from a record that continues nothing."""
        last = later if later.stamp > NEVER else self
        return Carry(last.opens, last.parent, last.stamp, max(self.high, later.high), later.now if later.now > NEVER else self.now, np.where(later.keys > NEVER, later.keys, self.keys))

    def packed(self) -> dict:
        known = np.flatnonzero(self.keys > NEVER)
        return {"opens": self.opens, "parent": self.parent, "stamp": self.stamp, "high": self.high, "now": self.now, "keys": [known.tolist(), self.keys[known].tolist()]}

    @classmethod
    def unpacked(cls, d: dict) -> Carry:
        out = cls(d["opens"], d["parent"], d["stamp"], d["high"], d["now"])
        out.keys[d["keys"][0]] = d["keys"][1]
        return out


@dataclass
class Facts:
    """Columns of facts of the records of a block; stamp is a calendar time in microseconds, or a counter."""

    follows: np.ndarray
    parents: list[list[int]]
    stamp: np.ndarray
    accepted: np.ndarray
    prev: np.ndarray
    high: np.ndarray
    back: np.ndarray


def stamps(first: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    up, mid, low = (words[np.minimum(first + k, len(words) - 1)].astype(np.int64) for k in (1, 2, 3))
    if width == 2:
        return up << 16 | mid
    return ((((up >> 5 & 511) * 24 + (up & 31)) * 60 + (mid >> 10)) * 60 + (mid >> 4 & 63)) * 1_000_000 + ((mid & 15) << 16 | low)


def facts(count: np.ndarray, words: np.ndarray, width: int, carry: Carry, after_gap: bool) -> Facts:
    """The facts of records that stand one behind the other, and carry moved on. after_gap: what was right before them was skipped."""
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    tw = words[first].astype(np.int32)
    spurious = tw & 127 == SPURIOUS_TYPE
    accepted = ~rejected(first, count, words, width)
    opens = accepted & ~spurious & (tw >> 14 & 1 == 1)
    before = np.concatenate([[carry.opens and not after_gap], opens[:-1]])
    follows = spurious & before
    stamp = stamps(first, words, width)
    own = lambda i: words[first[i] : first[i] + count[i]].astype(np.int32).tolist()
    at = np.flatnonzero(follows)
    parents = [own(i - 1) if i else carry.parent for i in at.tolist()]
    if len(at):
        stamp[at] = np.where(at > 0, stamp[at - 1], carry.stamp)  # a parent is no continuation itself
    good = np.flatnonzero(accepted)
    high = np.maximum.accumulate(np.concatenate([[carry.high], np.where(accepted, stamp, NEVER)]))[1:]
    back = np.zeros(len(stamp), bool)
    back[good] = np.diff(stamp[good], prepend=carry.now) < 0
    prev = np.full(len(stamp), NEVER, np.int64)
    keyed = np.flatnonzero(accepted & ~spurious)
    if len(keyed):
        key = words[first[keyed] + 1 + width].astype(np.int64) >> 5
        order = np.argsort(key, kind="stable")
        k, s = key[order], stamp[keyed][order]
        same = np.concatenate([[False], k[1:] == k[:-1]])
        prev[keyed[order]] = np.where(same, np.concatenate([[NEVER], s[:-1]]), carry.keys[k])
        last = np.concatenate([~same[1:], [True]])
        carry.keys[k[last]] = s[last]
    carry.high = int(high[-1])
    carry.stamp, carry.opens = int(stamp[-1]), bool(opens[-1])
    carry.parent = own(-1) if carry.opens else []
    if len(good):
        carry.now = int(stamp[good[-1]])
    return Facts(follows, parents, stamp, accepted, prev, high, back)


def cut_points(f: Facts, count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Records at which a file may be cut: accepted, continuing nothing, and at another time than the record right before them."""
    spurious = words[np.concatenate([[0], np.cumsum(count)[:-1]])] & 127 == SPURIOUS_TYPE
    return np.flatnonzero(f.accepted[1:] & ~spurious[1:] & (f.stamp[1:] != f.stamp[:-1])) + 1
