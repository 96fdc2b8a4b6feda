import random

import pytest
from pyspark.sql import functions as F

from busloom.operators import collapse

SCHEMA = "time_us long, file_index int, __d1 long, __d2 long, seq long, merge_us long"


def recorded(seed, n=900, back=True):
    """Rows of three files in the order of a merge; clocks step back, and stand still for a while."""
    r = random.Random(seed)
    rows = []
    for file in range(3):
        now, high = 0, 0
        for seq in range(n // 3):
            now += r.choice([0, 0, 1, 2, 5]) if not 100 < seq < 160 else 0
            us = now - (r.choice([0, 3, 30]) if back and r.random() < 0.1 else 0)
            us = None if r.random() < 0.02 else us
            high = max(high, us or 0)
            rows.append((us, file, r.randrange(6), 0, seq, high))
    return sorted(rows, key=lambda x: (x[5], x[1], x[4]))


def slow(rows, window, cap):
    """One record after the other."""
    kept, out = [], {}
    for us, file, d1, d2, seq, _ in rows:
        if us is None:
            out[file, seq] = (False, False)
            continue
        kept = [k for k in kept if abs(k[0] - us) <= window]
        dup, early = any(k[1] != file and k[2] == (d1, d2) for k in kept), False
        if not dup:
            kept.append((us, file, (d1, d2)))
            if cap is not None and len(kept) > cap:
                kept.pop(0)
                early = True
        out[file, seq] = (dup, early)
    return out


def in_blocks(spark, rows, window, cap, blocks):
    found, rounds = collapse.in_blocks(spark.createDataFrame(rows, SCHEMA), window, cap, blocks)
    got = {(r.f, r.s): (r.duplicate, r.early) for r in found.collect()}
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    return got, rounds, tasks


@pytest.mark.parametrize("seed,window,cap", [(0, 10, None), (1, 40, 5), (2, 10_000, 4), (3, 0, 3), (4, 25, 1), (5, 10, 4096)])
def test_blocks_give_what_one_walk_gives(spark, seed, window, cap):
    rows = recorded(seed)
    got, rounds, tasks = in_blocks(spark, rows, window, cap, 7)
    assert got == slow(rows, window, cap) and tasks > 3 and rounds >= 2


def test_a_difference_goes_through_all_blocks(spark):
    """Nothing ever leaves, so each block's last set hangs on all before it."""
    rows = recorded(9, 300)
    got, rounds, tasks = in_blocks(spark, rows, 1 << 40, None, 5)
    assert got == slow(rows, 1 << 40, None) and rounds > 2 and tasks > 2


def test_blocks_meet_after_two_rounds(spark):
    """Files in order and a small window: a block looks again at its first rows only."""
    got, rounds, tasks = in_blocks(spark, recorded(3, 3000, back=False), 8, None, 8)
    assert rounds == 2 and tasks == 8 and got == slow(recorded(3, 3000, back=False), 8, None)


def test_no_rows_and_one_time(spark):
    assert in_blocks(spark, [], 5, 2, 4)[0] == {}
    rows = [(5, i % 2, i % 3, 0, i, 5) for i in range(50)]
    rows.sort(key=lambda x: (x[5], x[1], x[4]))
    assert in_blocks(spark, rows, 0, 2, 4)[0] == slow(rows, 0, 2)


def test_a_set_of_survivors_enters_as_it_was():
    r = random.Random(1)
    one = collapse.Survivors(20, 6)
    for i in range(200):
        one.duplicate(i // 2 - r.choice([0, 15]), i % 3, (r.randrange(4), -7), i)
    other = collapse.Survivors(20, 6).enter(one.state())
    assert other.state() == one.state() and other.told == one.told
    for i in range(200, 300):
        us, d = i // 2 - r.choice([0, 15]), (r.randrange(4), -7)
        assert one.duplicate(us, i % 3, d, i) == other.duplicate(us, i % 3, d, i)


@pytest.mark.parametrize("cap,want", [(4096, 4), (1 << 20, 1), (None, 4)])
def test_all_survivors_fit_the_driver(spark, cap, want):
    assert collapse.blocks_for(spark.range(1), cap) == want
