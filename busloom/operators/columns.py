"""Results as tables: chosen fields, padded words, values for absent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UsageError
from ..schema import FIELDS, MAX_DATA_WORDS


def padded_words(words="data_words"):
    """The words of a record in an array of fixed length, zeros behind them."""
    return F.slice(F.concat(F.coalesce(F.col(words), F.array().cast("array<int>")), F.array_repeat(F.lit(0), MAX_DATA_WORDS)), 1, MAX_DATA_WORDS)


def columns(df: DataFrame, fields: list[str] | None = None, *, padded: bool = False, sentinels: bool = False) -> DataFrame:
    """The given public fields (all by default). Absent values are null, or with sentinels -1, NaN and False."""
    chosen = list(fields or FIELDS)
    unknown = [f for f in chosen if f not in FIELDS]
    if unknown or len(set(chosen)) != len(chosen):
        raise UsageError(f"fields: {unknown or 'repeated'}")
    out = df.select(*(padded_words().alias(c) if padded and c == "data_words" else F.col(c) for c in chosen))
    if not sentinels:
        return out
    fill = {}
    for f in out.schema.fields:
        if isinstance(f.dataType, T.IntegralType):
            fill[f.name] = F.coalesce(f.name, F.lit(-1).cast(f.dataType))
        elif isinstance(f.dataType, T.DoubleType):
            fill[f.name] = F.coalesce(f.name, F.lit(float("nan")))
        elif isinstance(f.dataType, T.BooleanType):
            fill[f.name] = F.coalesce(f.name, F.lit(False))
    return out.withColumns(fill)
