"""From recordings to records, tables and files."""

from __future__ import annotations

import logging
import os
import shutil
import uuid
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import NO_RECORDS, SUCCESS, SYNC_LOSS, BackwardStep, MergeIncompatible, NoValidRecords, PayloadError, RecordingError, UnknownErrorCode, UsageError, from_status
from ..functions import words
from ..operators import collapse as collapsing
from ..operators import decode as decoding
from ..operators import delta, filters, merge, order, pairing
from ..operators.columns import columns
from ..schema import MICROS_PER_DAY, SPURIOUS_TYPE
from ..shared import shared_path
from ..sources import sink
from ..sources.recording import Surveyed, read_pieces, read_raw, surveyed
from ..sources.selection import Selection

log = logging.getLogger("busloom")
#: Words of a body that tell the commands of a record, and fields that need no more of it.
HEAD_WORDS = 2
HEAD_FIELDS = {"file_offset", "timestamp", "time_us", "ticks", "freerun", "day_of_year", "time_of_day_us", "datetime", "message_type", "message_format", "bus", "error", "rt", "subaddress", "direction", "msg_label", "command_word", "delta", "mux"}
FINE = ("complete", "empty-recording", "partial-recovered", "truncated-tail")


@dataclass
class Outcome:
    """What a run did, for those who report it. Counters are filled once the records have been written or counted."""

    files: list[sink.Written] = field(default_factory=list)
    statuses: list[dict] = field(default_factory=list)
    left_out: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=dict)
    exit_code: int = SUCCESS
    _watched: list[Observation] = field(default_factory=list)

    def warn(self, text: str) -> None:
        self.warnings.append(text)
        log.warning(text)

    def watch(self, df: DataFrame, **sums: Column) -> DataFrame:
        """df; what its rows come to is counted as it is read."""
        o = Observation()
        self._watched.append(o)
        return df.observe(o, *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in sums.items()))

    def finish(self) -> None:
        """Take in what was counted, and warn of what should be known."""
        for o in self._watched:
            self.counters |= o.get
        self._watched.clear()
        for key, text in _NOTES.items():
            if n := self.counters.get(key, 0):
                self.warn(text.format(n))


#: What counters above zero say.
_NOTES = {
    "rejected": "{} record(s) were skipped: their words contradict each other", "status_mismatch": "{} record(s) have a status word of another terminal",
    "unknown_codes": "{} record(s) have an error code that isn't known",
    "reserved_bits": "{} record(s) have the reserved bit set", "free_running": "{} record(s) were stamped by a free-running clock",
    "wrapped_days": "{} step(s) back to an earlier day: a recording that crosses a year is dated by the year it began in; cut it there and give each part its own year",
    "capped_runs": "{} run(s) of equal times were longer than the sort group: their full groups stay in order of arrival", "capped_survivors": "{} record(s) left the window of duplicates early, for the cap",
}


def _source_options(c: Config) -> dict:
    return {"input_time_format": c.input_time_format, "strict": c.strict, "detect_records": c.detect_records, "lookahead_records": c.lookahead_records, "mux_enabled": c.mux_enabled, "mux_delimiter": c.mux_delimiter, "mux_field": c.mux_field, "mux_value": c.mux_value}


def raw(spark: SparkSession, paths: list[str], config: Config | None = None) -> DataFrame:
    return read_raw(spark, paths, **_source_options(config or Config()))


def survey(spark: SparkSession, paths: list[str], config: Config | None = None) -> list[Surveyed]:
    """How files are cut, and how each ended."""
    return surveyed(spark, paths, **_source_options(config or Config()))


def statuses(spark: SparkSession, paths: list[str], config: Config | None = None) -> list[dict]:
    """How each file ended."""
    return _statuses(survey(spark, paths, config), paths)


def _statuses(found: list[Surveyed], paths: list[str]) -> list[dict]:
    return [f.status | {"file_index": i, "path": p} for i, (f, p) in enumerate(zip(found, paths, strict=True))]


def records(raw_rows: DataFrame, config: Config | None = None, outcome: Outcome | None = None) -> DataFrame:
    """Decoded, paired records with their per-file DELTA. In strict mode a file ends before its first bad record."""
    c = config or Config()
    decoded = decoding.decode(raw_rows, tick_rate_hz=c.standard_tick_rate_hz)
    if c.strict:
        stops = F.broadcast(decoding.first_rejects(decoded).select(F.col("file_index").alias("__f"), F.col("seq").alias("__stop")))  # a row for each file at most
        decoded = decoded.join(stops, F.col("file_index") == F.col("__f"), "left").filter("__stop is null or seq < __stop").drop("__f", "__stop")
    if outcome is not None:
        plain_error = (F.col("kind") == "rec") & F.col("error") & (F.col("message_type") != SPURIOUS_TYPE)
        plain = (F.col("kind") == "rec") & ~F.col("error") & (F.col("message_type") != SPURIOUS_TYPE)
        decoded = outcome.watch(decoded, rejected=F.col("kind") == "skip", status_mismatch=plain & (words.status_rt(F.col("status_word")) != F.col("rt")), reserved_bits=plain & words.type_reserved(F.col("type_word")), unknown_codes=plain_error & ~words.is_known_error(F.col("error_word")), free_running=F.coalesce("freerun", F.lit(False)))
    # texts of time last: where they aren't asked for, they are never made
    return decoding.with_times(delta.with_delta(pairing.pair(decoded)), year=c.year, utc_offset=c.utc_offset, time_format=c.output_time_format)


def check(raw_rows: DataFrame, found: list[dict], config: Config) -> list[RecordingError]:
    """The failures of a run's files, in their order."""
    out = [from_status(s["state"], f"{s['path']}: {s['detail']}") for s in found if s["state"] not in FINE]
    if config.strict:
        decoded = decoding.decode(raw_rows)
        for r in decoding.first_rejects(decoded).orderBy("file_index").collect():
            kind = UnknownErrorCode if r.reason == "unknown-error-code" else PayloadError
            out.append(kind(f"input {r.file_index}: {r.reason} at 0x{r.file_offset:X}"))
    return out


def merge_recordings(recs: DataFrame, config: Config | None = None, outcome: Outcome | None = None, monotone: bool | None = None) -> DataFrame:
    """Records of several recordings, to be put in the order of time, duplicates collapsed if asked for, with DELTA of the given scope.

    monotone: whether all files are in order of time, if that is known; then they are also known to be mergeable.
    """
    c = config or Config()
    if monotone is None:
        merge.check_mergeable(recs)
        monotone = merge.check_monotone(recs, c.strict)
    out = merge.merged(recs)
    if c.collapse_duplicates:
        out = collapsing.marked(out, c.collapse_window_us, c.max_collapse_survivors, monotone)
        if outcome is not None:
            out = outcome.watch(out, collapsed=F.col("collapsed"), **({"capped_survivors": F.col("capped")} if "capped" in out.columns else {}))
        out = out.filter("not collapsed").drop("collapsed", "capped")
    if c.delta_scope == "global":
        out = delta.with_delta(out, "global", merge.ORDER)
    return out


@dataclass
class Analysis:
    """Records that the filters leave, in no order yet; position gives their order of arrival, or of the merge."""

    records: DataFrame
    position: tuple[str, ...]
    by: tuple[str, ...]
    monotone: bool
    outcome: Outcome
    arranged: bool = False  # whether rows stand in that order already, partition by partition
    unfiltered: DataFrame | None = None  # records before the filters

    def ordered(self, max_group: int) -> tuple[DataFrame, list]:
        """Records with the columns that give their canonical order, and these."""
        return order.order_rows(self.records, max_group, self.position, self.by, self.monotone), order.sort_columns(self.position)

    def finish(self) -> None:
        """The outcome's counters, and a warning for each key whose time steps back. Keys are looked up only if some do."""
        self.outcome.finish()
        if not self.outcome.counters.get("backward_gaps") or self.unfiltered is None:
            return
        back = self.unfiltered.filter("rt is not null and time_us is not null and delta_us is null")
        keys = back.groupBy("file_index", "rt", "subaddress", "direction").agg(F.count("*").alias("steps"), F.min("file_offset").alias("first"))
        for r in keys.orderBy("file_index", "rt", "subaddress", "direction").collect():  # 2,048 keys a file
            self.outcome.warn(f"input {r.file_index}, key {r.rt}:{r.subaddress}[{'T' if r.direction else 'R'}]: {r.steps} step(s) back in time, the first at 0x{r.first:X}: no DELTA there")


def analysis(spark: SparkSession, paths: list[str], config: Config | None = None, arrange: bool = False, fields: list[str] | None = None, push: bool = False, since_us: int | None = None, until_us: int | None = None) -> Analysis:
    """Records of one or more files, filtered, and how the files ended. since_us, until_us: the range of times (time_us) asked for, its end left out.

    push: have the source leave out what filters and range don't want, wherever nothing else looks at it; what it would tell isn't counted.

    arrange: put raw rows in the order of a merge, if nothing between there and the end needs them otherwise. They are narrower than
    records, and all that makes records of them keeps the order. fields: what is asked for of the records; where that needs no
    words but the first, no others leave the source, and what they would tell isn't counted.
    """
    c = config or Config()
    if len(paths) > 1 and c.mux_value is not None:
        raise UsageError("a fixed mux value is for one input")
    found = survey(spark, paths, c)
    outcome = Outcome(statuses=_statuses(found, paths))
    for s in outcome.statuses:
        for w in s["warnings"]:
            outcome.warn(f"{s['path']}: {w}")
        if s["sync_losses"]:
            outcome.counters["sync_losses"] = outcome.counters.get("sync_losses", 0) + s["sync_losses"]
    failed = [s for s in outcome.statuses if s["state"] not in FINE]
    if failed and (len(paths) == 1 or not c.allow_partial):
        s = failed[0]
        if not (c.allow_partial and s["state"] == "UnrecoverableSyncLoss"):
            raise from_status(s["state"], f"{s['path']}: {s['detail']}")
    unusable = [s["file_index"] for s in failed if not s["records"]]
    if len(unusable) == len(paths):
        raise from_status(failed[0]["state"], f"{failed[0]['path']}: {failed[0]['detail']}")
    if c.strict and (bad := [e for e in check(raw_of(spark, found, unusable, c), outcome.statuses, c) if isinstance(e, (PayloadError, UnknownErrorCode))]):
        raise bad[0]
    monotone = all(not f.back for f in found)
    if len(paths) > 1:
        for i, f in enumerate(found):
            if i in unusable or f.first is None:
                continue
            if f.status["ts_format"] != "irig" or f.first["freerun"]:
                told = f"input {i} starts {'with a free-running clock' if f.first['freerun'] else 'with counter times'}"
                if not c.allow_partial:
                    raise MergeIncompatible(told)
                outcome.warn(f"{paths[i]}: left out: {told}")
                unusable.append(i)
        if len(unusable) == len(paths):
            raise MergeIncompatible("no input can be merged")
        for i, f in enumerate(found):
            if f.back and i not in unusable:
                told = f"input {i} steps back in time at record {f.first_back}"
                if c.strict:
                    raise BackwardStep(told)
                outcome.warn(f"{paths[i]}: {f.back} step(s) back in time, the first at record {f.first_back}: the merge isn't in order of time there")
    outcome.left_out = [paths[i] for i in sorted(unusable)]
    head = fields is not None and set(fields) <= HEAD_FIELDS and not c.strict and not c.collapse_duplicates
    apart = not c.strict and not c.collapse_duplicates and (len(paths) == 1 or c.delta_scope != "global" or fields is not None and "delta" not in fields)
    select = Selection.of(c.filters, since_us, until_us) if push and apart else None
    rows = raw_of(spark, found, unusable, c, HEAD_WORDS if head else None, select)
    arrange = arrange and (len(paths) == 1 or monotone and not c.collapse_duplicates and c.delta_scope == "per-file")
    if arrange and len(paths) > 1:
        rows = rows.filter("kind = 'rec'").repartitionByRange("high").sortWithinPartitions("high", "file_index", "seq")
    recs = records(rows, c, None if head else outcome)
    position: tuple[str, ...] = ("file_index", "seq")
    if len(paths) > 1:
        recs = merge_recordings(recs, c, outcome, monotone)
        position = merge.ORDER
    if any(f.status["ts_format"] == "irig" for f in found) and c.irig_day_advisory:
        # a caution about the recorders, not about this recording: it is loud where days become dates
        log.log(logging.INFO if c.output_time_format == "doy" else logging.WARNING, "the day of the year is as the recording card gave it, which on some cards is not the calendar's; times of day are not affected")
    if c.output_time_format != "doy":
        recs = outcome.watch(recs, wrapped_days=F.col("back") & (F.floor(F.col("merge_us") / MICROS_PER_DAY) > F.col("day_of_year")))
    recs = outcome.watch(recs, backward_gaps=F.col("rt").isNotNull() & F.col("time_us").isNotNull() & F.col("delta_us").isNull())
    unfiltered = recs
    if c.filters.active:
        recs = outcome.watch(filters.verdicts(recs, c.filters), filtered=F.col("filtered")).filter("not filtered").drop("filtered")
    for side in ([F.col("time_us") >= since_us] if since_us is not None else []) + ([F.col("time_us") < until_us] if until_us is not None else []):
        recs = recs.filter(side)
    recs = outcome.watch(recs, kept=F.lit(1))
    if failed or outcome.left_out:
        outcome.exit_code = SYNC_LOSS if any(s["state"] == "UnrecoverableSyncLoss" for s in failed) or outcome.left_out else SUCCESS
    return Analysis(recs, position, () if len(paths) > 1 else ("file_index",), monotone, outcome, arrange, unfiltered)


def raw_of(spark: SparkSession, found: list[Surveyed], without: list[int], config: Config, body_words: int | None = None, select: Selection | None = None) -> DataFrame:
    """Raw rows of the files that were surveyed, but for some, or of those that are selected; of their bodies all words, or only the first few."""
    return read_pieces(spark, [p for i, f in enumerate(found) if i not in without for p in f.pieces], select, **_source_options(config), body_words=body_words)


def _lines(spark: SparkSession, paths: list[str], c: Config, folder: str, split: bool) -> tuple[sink.Parts, Outcome]:
    """Write the lines of the table in parts."""
    a = analysis(spark, paths, c, arrange=True)
    sink.check_calendar(a.records, c.output_time_format, c.year)
    merged = len(paths) > 1
    if not a.monotone and (merged or c.filters.active):
        rows, by = a.ordered(c.max_sort_group)  # a run may go on where a partition ends
        parts = sink.write_parts(rows.orderBy(*by), folder, split, 1)
    else:
        # rows of one time never come apart: not by the pieces of a file, nor by ranges of time
        rows = a.records if a.arranged else a.records.repartitionByRange("merge_us").sortWithinPartitions(*merge.ORDER)
        parts = sink.write_parts(rows, folder, split, c.max_sort_group)
    a.finish()
    if parts.capped and c.max_sort_group > 1:
        a.outcome.counters["capped_runs"] = parts.capped
        a.outcome.warn(_NOTES["capped_runs"].format(parts.capped))
    return parts, a.outcome


def decode_to_csv(spark: SparkSession, paths: list[str], path: str, config: Config | None = None) -> Outcome:
    """Write the CSV table of one or more recordings to one file, or to one and another for the errors."""
    c = config or Config()
    split = c.error_mode == "separate"
    sink.refuse_inputs(sink.names_of(path, split), paths)
    for p in (path, sink.errors_path(path)) if split else (path,):
        sink.CsvFile(p, c.no_clobber)
    folder = os.path.join(os.path.dirname(os.path.abspath(path)), f".{os.path.basename(path)}.{uuid.uuid4().hex}.tmp")
    try:
        parts, outcome = _lines(spark, paths, c, folder, split)
        partial = outcome.exit_code == SYNC_LOSS
        outcome.files.append(sink.CsvFile(path, c.no_clobber, partial).place(spark, parts.main, parts.rows))
        if parts.error_rows:
            outcome.files.append(sink.CsvFile(sink.errors_path(path), c.no_clobber, partial).place(spark, parts.errors, parts.error_rows))
        return outcome
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def decode_to_stream(spark: SparkSession, paths: list[str], out: BinaryIO, config: Config | None = None, folder: str | None = None) -> Outcome:
    """The same into a stream of bytes, such as standard output. Parts are made in a folder that all executors see."""
    c = config or Config()
    if c.error_mode == "separate":
        raise UsageError("a stream takes one table; errors go to a file of their own")
    folder = os.path.join(folder or shared_path(spark), f".stream.{uuid.uuid4().hex}.tmp")
    try:
        parts, outcome = _lines(spark, paths, c, folder, False)
        sink.write_all(out, parts.main)
        out.flush()
        return outcome
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def decode_to_folder(spark: SparkSession, paths: list[str], folder: str, config: Config | None = None) -> Outcome:
    """The same as many files in a folder of any store that Spark writes, in parallel; sorted by name, they follow each other in order."""
    c = config or Config()
    a = analysis(spark, paths, c)
    sink.check_calendar(a.records, c.output_time_format, c.year)
    rows, by = a.ordered(c.max_sort_group)
    sink.write_folder(rows, folder, by)
    a.finish()
    return a.outcome


def count(spark: SparkSession, path: str, config: Config | None = None) -> int:
    """Records of one file that the settings' filters leave."""
    c = config or Config()
    found = survey(spark, [path], c)
    status = _statuses(found, [path])[0]
    if status["state"] not in FINE:
        raise from_status(status["state"], f"{path}: {status['detail']}")
    if not c.strict and not c.filters.active:
        return found[0].accepted
    select = None if c.strict else Selection.of(c.filters)
    return counted(records(raw_of(spark, found, [], c, None if c.strict else HEAD_WORDS, select), c), c).first().n


def counted(recs: DataFrame, config: Config) -> DataFrame:
    """n: how many records the settings' filters leave."""
    return filters.apply_filters(recs, config.filters).agg(F.count("*").alias("n"))


def table(spark: SparkSession, paths: list[str], fields: list[str] | None = None, config: Config | None = None, since_us: int | None = None, until_us: int | None = None, **options) -> DataFrame:
    """Public fields of one or more recordings, in canonical order; of all times, or of a range whose end is left out."""
    df, by = analysis(spark, paths, config, fields=fields, push=True, since_us=since_us, until_us=until_us).ordered((config or Config()).max_sort_group)
    return columns(df.orderBy(*by), fields, **options)


def exit_code(error: BaseException | None) -> int:
    """The exit code of a run: that of its error's class."""
    return SUCCESS if error is None else getattr(error, "exit_code", NO_RECORDS if isinstance(error, NoValidRecords) else 1)
