"""Input lists: paths, manifests and wildcards, and what a file name tells."""

from __future__ import annotations

import os
import re
from pathlib import Path

from ..errors import UsageError

MAX_FILES = 256


def read_manifest(path: str) -> list[str]:
    """Paths of a manifest: UTF-8 lines without blanks at either end; empty lines and those with # first are skipped."""
    try:
        text = Path(path).read_bytes().decode("utf-8")
    except UnicodeDecodeError as e:
        raise UsageError(f"{path}: not UTF-8") from e
    lines = (line.removesuffix("\r").strip(" \t\n\r\x0b\x0c") for line in text.split("\n"))
    return [line for line in lines if line and not line.startswith("#")]


def glob_regex(pattern: str) -> re.Pattern[str]:
    """A pattern in which * is any run and ? any one character; all else, brackets included, stands for itself."""
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", pattern)), re.S)


def expand_glob(pattern: str) -> list[str]:
    """Regular files whose name matches the last part of the pattern, sorted by path. Folders take no wildcard."""
    folder, name = os.path.split(pattern)
    if re.search(r"[*?]", folder):
        raise UsageError(f"{pattern}: wildcards are for file names only")
    match = glob_regex(name).fullmatch
    found = sorted(e.path if folder else e.name for e in os.scandir(folder or ".") if match(e.name) and e.is_file())
    if not found:
        raise UsageError(f"{pattern}: no file matches")
    return found


def resolve(paths: list[str] | None = None, manifest: str | None = None, glob: str | None = None) -> list[str]:
    """The inputs in order, from exactly one of the three."""
    given = [x for x in (paths, manifest, glob) if x]
    if len(given) != 1:
        raise UsageError("give paths, a manifest or a glob, and only one of them")
    found = list(paths) if paths else read_manifest(manifest) if manifest else expand_glob(glob)
    if not found:
        raise UsageError("no inputs")
    if len(found) > MAX_FILES:
        raise UsageError(f"{len(found)} inputs; {MAX_FILES} at most")
    return found


def mux_of(path: str, enabled: bool = True, delimiter: str = ".", index: int = 4, value: str | None = None) -> str | None:
    """The multiplexer name: a fixed value, or a field of the file name (from the end if index is negative)."""
    if value is not None:
        if not enabled:
            raise UsageError("a fixed mux value needs mux to be enabled")
        if not value:
            raise UsageError("the mux value is empty")
        return value
    if not enabled or not delimiter:
        return None
    parts = os.path.basename(path).split(delimiter)
    if not -len(parts) <= index < len(parts):
        return None
    return parts[index].strip(" \t") or None
