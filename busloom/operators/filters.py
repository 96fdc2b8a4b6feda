"""Message filters: exclusions, inclusions, and continuations that follow their parents."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..schema import MESSAGE_TYPES, SPURIOUS_TYPE
from .pairing import is_continuation, parent_fields


@dataclass(frozen=True)
class Filters:
    exclude_types: tuple[int, ...] = ()
    exclude_rts: tuple[int, ...] = ()
    exclude_buses: tuple[int, ...] = ()
    exclude_subaddresses: tuple[int, ...] = ()
    include_types: tuple[int, ...] = ()
    include_rts: tuple[int, ...] = ()
    include_buses: tuple[int, ...] = ()
    include_subaddresses: tuple[int, ...] = ()

    @property
    def active(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self))

    def with_lists(self, **more) -> Filters:
        """These filters with values added to their lists, each once."""
        return Filters(**{f.name: tuple(dict.fromkeys((*getattr(self, f.name), *more.get(f.name, ())))) for f in fields(self)})


def parse_type(text: str) -> int:
    """A message type by name or hexadecimal code, whatever its case."""
    t = text.strip().upper()
    by_name = {n: c for c, n in MESSAGE_TYPES.items()}
    if t in by_name:
        return by_name[t]
    try:
        code = int(t, 16) if t.startswith("0X") else None
    except ValueError:
        code = None
    if code not in MESSAGE_TYPES:
        raise ConfigError(f"message type {text!r}")
    return code


def parse_bus(text: str) -> int:
    t = text.strip().upper()
    if t not in ("A", "B"):
        raise ConfigError(f"bus {text!r}: A or B")
    return int(t == "B")


def parse_address(value) -> int:
    n = int(value)
    if not 0 <= n <= 31:
        raise ConfigError(f"address {value}: 0 to 31")
    return n


_LISTS = (("types", "message_type"), ("rts", "rt"), ("buses", "bus"), ("subaddresses", "subaddress"))


def _any(f: Filters, side: str, names: tuple[str, ...], of: dict[str, Column] | None = None) -> list[Column]:
    return [F.coalesce((of or {}).get(c, F.col(c)).isin(*getattr(f, f"{side}_{n}")), F.lit(False)) for n, c in _LISTS if n in names and getattr(f, f"{side}_{n}")]


def _or(cols: list[Column]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c
    return out


def dropped(f: Filters, include_types: bool = True, of: dict[str, Column] | None = None) -> Column:
    """Whether a record's own values (or those of) drop it. A null terminal or subaddress is never excluded and never included."""
    names = ("types", "rts", "buses", "subaddresses")
    excluded = _or(_any(f, "exclude", names, of))
    included = _any(f, "include", names if include_types else names[1:], of)
    return excluded | _or([~c for c in included])


def verdicts(df: DataFrame, filters: Filters) -> DataFrame:
    """df with filtered: whether the filters drop a record. A continuation right behind its parent goes with it, or for its own type alone.

    'Right behind' is meant in the order of arrival in a file. That holds for merged records too: a continuation has its
    parent's time, so nothing comes between them in the order of a merge either. If the source tells the words of a parent
    this is a projection, else a window by file.
    """
    if not filters.active:
        return df.withColumn("filtered", F.lit(False))
    own_type = _or(_any(filters, "exclude", ("types",))) | _or([~c for c in _any(filters, "include", ("types",))])
    if "parent" in df.columns:
        gone = dropped(filters, False, parent_fields())
        return df.withColumn("filtered", F.when(is_continuation() & F.col("parent").isNotNull(), gone | own_type).otherwise(dropped(filters)))
    parent = (F.col("error") & (F.col("message_type") != SPURIOUS_TYPE)).alias("parent")
    state = F.struct(parent, dropped(filters, include_types=False).alias("gone"))
    df = df.withColumn("__behind", F.lag(state).over(Window.partitionBy("file_index").orderBy("seq")))
    follows = is_continuation() & F.coalesce(F.col("__behind.parent"), F.lit(False))
    return df.withColumn("filtered", F.when(follows, F.col("__behind.gone") | own_type).otherwise(dropped(filters))).drop("__behind")


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Records that the filters leave."""
    return verdicts(df, filters).filter("not filtered").drop("filtered") if filters.active else df
