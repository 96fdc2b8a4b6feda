"""Command line: decode, count and dump.

    python -m busloom.cli decode a.rec b.rec -o out.csv --collapse-duplicates --delta-scope global
    python -m busloom.cli decode - < a.rec > out.csv
    python -m busloom.cli count a.rec --config settings.toml
    python -m busloom.cli dump a.rec --records 10
    python -m busloom.cli dump a.rec --raw --offset 0x40 --length 128

An input - is standard input, read to its end into a file that is removed afterwards; it has no name, and so no multiplexer.
Without an output, or with -o -, the table goes to standard output, errors inline.
"""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys
import tempfile

from . import __version__
from .config import Config, load
from .errors import ConfigError, RecordingError, UsageError
from .functions.render import parse_offset, printable
from .operators import dump
from .operators.filters import parse_address, parse_bus, parse_type
from .shared import shared_path
from .sources.inputs import resolve

_LISTS = {"types": parse_type, "rts": parse_address, "buses": parse_bus, "subaddresses": parse_address}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


def _everywhere(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
    """Options that stand before or behind a command."""
    for name, more in (("--config", {}), ("--log-level", {"choices": ["DEBUG", "INFO", "WARNING", "ERROR"]}), ("--no-irig-day-advisory", {"dest": "irig_day_advisory", "action": "store_const", "const": False})):
        p.add_argument(name, default=argparse.SUPPRESS, **more)
    return p


def parser() -> argparse.ArgumentParser:
    top = _everywhere(_Parser(prog="busloom", description=__doc__.split("\n")[0]))
    top.add_argument("-V", "--version", action="version", version=f"busloom {__version__}")
    sub = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    d = _everywhere(sub.add_parser("decode"))
    d.add_argument("inputs", nargs="*")
    d.add_argument("--manifest")
    d.add_argument("--glob")
    d.add_argument("-o", "--output", default="-")
    d.add_argument("--format", dest="output_format", choices=["csv"])
    d.add_argument("--separate-errors", dest="error_mode", action="store_const", const="separate")
    for name, choices in (("input-time-format", ["auto", "irig", "standard"]), ("error-mode", ["inline", "separate"]), ("output-time-format", ["doy", "iso", "dom"]), ("delta-scope", ["per-file", "global"])):
        d.add_argument(f"--{name}", choices=choices)
    for name in ("strict", "allow-partial", "no-clobber", "collapse-duplicates"):
        d.add_argument(f"--{name}", action="store_const", const=True)
    for name in ("detect-records", "lookahead-records", "year", "max-sort-group", "threads", "mux-field", "collapse-window-us", "max-collapse-survivors"):
        d.add_argument(f"--{name}", type=int)
    d.add_argument("--standard-tick-rate-hz", type=float)
    d.add_argument("--utc-offset")
    d.add_argument("--mux-value")
    d.add_argument("--mux-delimiter")
    d.add_argument("--no-mux", dest="mux_enabled", action="store_const", const=False)
    for side in ("exclude", "include"):
        for name in _LISTS:
            d.add_argument(f"--{side}-{name}", help="a comma-separated list")
    c = _everywhere(sub.add_parser("count"))
    c.add_argument("input")
    x = _everywhere(sub.add_parser("dump"))
    x.add_argument("--raw", action="store_true")
    x.add_argument("input")
    x.add_argument("--offset", type=lambda s: int(s, 0), default=0)
    x.add_argument("--length", type=lambda s: int(s, 0), default=None)
    x.add_argument("--records", type=int)
    return top


def settings(args: argparse.Namespace) -> Config:
    """Settings of the file under those of the command line."""
    given = {k: v for k, v in vars(args).items() if k in Config.__dataclass_fields__ and v is not None}
    if "utc_offset" in given:
        given["utc_offset"] = parse_offset(given["utc_offset"])
    for side in ("exclude", "include"):
        for name, read in _LISTS.items():
            if text := getattr(args, f"{side}_{name}", None):
                try:
                    given[f"{side}_{name}"] = tuple(read(x) for x in text.split(","))
                except ValueError as e:
                    raise ConfigError(str(e)) from None
    return load(getattr(args, "config", None), **given)


def _received(stream, folder: str) -> str:
    """Standard input, as a file."""
    if stream.isatty():
        raise UsageError("standard input is a terminal: pipe or redirect a recording into it")
    path = os.path.join(folder, "stdin")
    with open(path, "wb") as f:
        shutil.copyfileobj(stream, f, 1 << 20)
    return path


#: What a session of our own is started with. HotSpot does not compile methods over 8,000 bytes, such as a plan's widest would be made in one.
SESSION = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.session.timeZone": "UTC", "spark.sql.python.filterPushdown.enabled": "true"}


def run(argv: list[str], spark=None, out=None, stdin=None) -> int:
    """The exit code of a command line."""
    out = out or sys.stdout
    folder = None
    try:
        if any(a.partition("=")[0] == "--time-format" for a in argv):
            raise UsageError("--time-format has become two options: --input-time-format for what a recording holds, --output-time-format for what is written")
        args = parser().parse_args(argv)
        config = settings(args)
        logging.getLogger("busloom").setLevel(getattr(args, "log_level", None) or config.log_level)
        if args.command == "dump":
            for line in dump.hex_lines(args.input, args.offset, args.length if args.length is not None else 256) if args.raw else dump.record_lines(args.input, args.offset, args.records):
                print(line, file=out)
            return 0
        from .plans import recordings as plans

        if spark is None:
            from pyspark.sql import SparkSession

            starting = SparkSession.builder.appName("busloom")
            for k, v in SESSION.items():
                starting = starting.config(k, v)
            spark = starting.getOrCreate()
        paths = [args.input] if args.command == "count" else resolve(args.inputs or None, args.manifest, args.glob)
        if "-" in paths:
            if paths.count("-") > 1:
                raise UsageError("standard input can be read once")
            folder = tempfile.mkdtemp(prefix="stdin-", dir=shared_path(spark))  # tasks read it too
            received = _received(stdin or sys.stdin.buffer, folder)
            paths = [received if p == "-" else p for p in paths]
        if args.command == "count":
            print(plans.count(spark, paths[0], config), file=out)
            return 0
        if args.output != "-":
            return plans.decode_to_csv(spark, paths, args.output, config).exit_code
        if config.error_mode == "separate":
            logging.getLogger("busloom").warning("standard output takes one table: errors stay inline")
        return plans.decode_to_stream(spark, paths, getattr(out, "buffer", out), config.over(error_mode="inline")).exit_code
    except SystemExit as e:  # help or version was asked for
        return int(e.code or 0)
    except RecordingError as e:
        print(f"error: {printable(str(e))}", file=sys.stderr)
        return e.exit_code
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    logging.basicConfig(stream=sys.stderr, format="%(levelname)s: %(message)s")
    sys.exit(run(sys.argv[1:]))
