"""Compare a query with its SQL on DuckDB."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def compare(df, duck, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(sql)
    cols = [d[0] for d in found.description]
    assert sorted(cols) == names
    want = sorted((tuple(_plain(row[cols.index(c)]) for c in names) for row in found.fetchall()), key=repr)
    assert got == want
