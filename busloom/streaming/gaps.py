"""DELTA over a stream of records, with one small state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "file_index int, rt int, subaddress int, direction int, seq long, time_us long, delta_us long"


def _observe(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")  # one key's rows of one micro-batch
    last, seen = state.get if state.exists else (None, None)
    seq, us = rows["seq"].to_numpy(), rows["time_us"].to_numpy()
    if seen is not None and seq[0] <= seen:
        raise ValueError(f"record {seq[0]} of {key} comes after record {seen}: a stream must come in order of arrival")
    before = np.concatenate([[us[0] if last is None else last], us[:-1]])
    state.update((int(us[-1]), int(seq[-1])))
    gaps = pd.array(us - before, "Int64")
    gaps[us < before] = pd.NA
    yield pd.DataFrame({**dict(zip(("file_index", "rt", "subaddress", "direction"), key, strict=True)), "seq": seq, "time_us": us, "delta_us": gaps})


def stream_delta(records: DataFrame) -> DataFrame:
    """Gaps of a stream of records that come in order of seq: the same values as the batch operator gives.

    State is two longs for each key, of which a file has at most 2,048; it is kept, as a key may come back at any time. A record
    that comes after a later one of its key stops the stream, as its gap can't be told any more.
    """
    known = records.filter("rt is not null and time_us is not null").select("file_index", "rt", "subaddress", "direction", "seq", "time_us")
    return known.groupBy("file_index", "rt", "subaddress", "direction").applyInPandasWithState(_observe, OUTPUT, "last long, seq long", "append", GroupStateTimeout.NoTimeout)
