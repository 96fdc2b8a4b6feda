"""Settings: defaults, a TOML file over them, and what a caller gives over both."""

from __future__ import annotations

import logging
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from .errors import ConfigError
from .functions.render import parse_offset
from .operators.filters import Filters, parse_address, parse_bus, parse_type

log = logging.getLogger("busloom")


@dataclass(frozen=True)
class Config:
    input_time_format: str = "auto"
    strict: bool = False
    error_mode: str = "inline"
    allow_partial: bool = False
    detect_records: int = 8
    lookahead_records: int = 2
    standard_tick_rate_hz: float | None = None
    filters: Filters = field(default_factory=Filters)
    output_format: str = "csv"
    no_clobber: bool = False
    output_time_format: str = "doy"
    year: int | None = None
    utc_offset: int = 0
    max_sort_group: int = 65_536
    threads: int | None = None  # accepted; Spark has its own
    mux_enabled: bool = True
    mux_delimiter: str = "."
    mux_field: int = 4
    mux_value: str | None = None
    delta_scope: str = "per-file"
    collapse_duplicates: bool = False
    collapse_window_us: int = 0
    max_collapse_survivors: int = 4096
    log_level: str = "WARNING"
    irig_day_advisory: bool = True

    def __post_init__(self) -> None:
        for name, allowed in (("input_time_format", ("auto", "irig", "standard")), ("error_mode", ("inline", "separate")), ("output_time_format", ("doy", "iso", "dom")), ("output_format", ("csv",)), ("delta_scope", ("per-file", "global"))):
            if getattr(self, name) not in allowed:
                raise ConfigError(f"{name}: {getattr(self, name)!r}, not one of {', '.join(allowed)}")
        for name, low, high in (("detect_records", 1, 32), ("lookahead_records", 1, 32), ("max_sort_group", 1, 1 << 20), ("max_collapse_survivors", 1, 1 << 20), ("collapse_window_us", 0, 1 << 62)):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or not low <= v <= high:
                raise ConfigError(f"{name}: {v!r}, not from {low} to {high}")
        if self.threads is not None and not 0 <= self.threads <= 16:
            raise ConfigError("threads: 0 to 16")
        if self.year is not None and not 1 <= self.year <= 9999:
            raise ConfigError(f"year: {self.year}, not from 1 to 9999")
        hz = self.standard_tick_rate_hz
        if hz is not None and not 0 < hz < float("inf"):
            raise ConfigError(f"standard_tick_rate_hz: {hz}")
        if not -1439 <= self.utc_offset <= 1439:
            raise ConfigError("utc_offset: beyond 23:59")

    def over(self, **given) -> Config:
        """These settings with given ones over them; filter lists add up, and None means not given."""
        lists = {k: tuple(v) for k, v in given.items() if k.startswith(("exclude_", "include_")) and v}
        rest = {k: v for k, v in given.items() if not k.startswith(("exclude_", "include_")) and v is not None}
        try:
            return replace(self, filters=self.filters.with_lists(**lists), **rest)
        except TypeError as e:
            raise ConfigError(str(e)) from None


#: Sections and keys of a settings file (fixed names), with the setting that each gives.
SECTIONS = {
    "decode": {"input_time_format": "input_time_format", "strict": "strict", "error_mode": "error_mode", "allow_partial": "allow_partial", "detect_records": "detect_records", "lookahead_records": "lookahead_records", "standard_tick_rate_hz": "standard_tick_rate_hz"},
    "filter": {"exclude_types": "exclude_types", "exclude_rts": "exclude_rts", "exclude_buses": "exclude_buses", "exclude_subaddresses": "exclude_subaddresses"},
    "output": {"format": "output_format", "no_clobber": "no_clobber", "output_time_format": "output_time_format", "year": "year", "utc_offset": "utc_offset", "max_sort_group": "max_sort_group", "threads": "threads"},
    "mux": {"enabled": "mux_enabled", "delimiter": "mux_delimiter", "field": "mux_field", "value": "mux_value"},
    "merge": {"delta_scope": "delta_scope", "collapse_duplicates": "collapse_duplicates", "collapse_window_us": "collapse_window_us", "max_collapse_survivors": "max_collapse_survivors"},
    "logging": {"level": "log_level", "irig_day_advisory": "irig_day_advisory"},
}
_PARSERS = {"exclude_types": lambda v: parse_type(v) if isinstance(v, str) else v, "exclude_buses": parse_bus, "exclude_rts": parse_address, "exclude_subaddresses": parse_address}


def parse(text: str, base: Config | None = None) -> Config:
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from None
    given: dict = {}
    for section, values in found.items():
        known = SECTIONS.get(section)
        if known is None or not isinstance(values, dict):
            log.warning("settings: [%s] isn't known", section)
            continue
        for key, value in values.items():
            if key not in known:
                log.warning("settings: %s.%s isn't known", section, key)
                continue
            name = known[key]
            if name == "utc_offset" and isinstance(value, str):
                value = parse_offset(value)
            elif name in _PARSERS:
                if not isinstance(value, list):
                    raise ConfigError(f"{section}.{key}: not a list")
                value = tuple(_PARSERS[name](v) for v in value)
            elif isinstance(getattr(base or Config(), name, None), bool) and not isinstance(value, bool):
                raise ConfigError(f"{section}.{key}: true or false")
            given[name] = value
    return (base or Config()).over(**given)


def load(path: str | None, **given) -> Config:
    """Settings of a file, if any, with given ones over them."""
    if path is None:
        return Config().over(**given)
    try:
        text = Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from None
    return parse(text).over(**given)
