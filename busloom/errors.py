"""Failures by kind, each with the exit code of its class."""

from __future__ import annotations

SUCCESS, RUNTIME, NO_RECORDS, SYNC_LOSS, USAGE, CONFIG, INCOMPATIBLE = range(7)


class RecordingError(Exception):
    exit_code = RUNTIME


class FileMissing(RecordingError):
    pass


class FileUnreadable(RecordingError):
    pass


class EmptyFile(RecordingError):
    exit_code = NO_RECORDS


class NoValidRecords(RecordingError):
    exit_code = NO_RECORDS


class FirstRecordTruncated(NoValidRecords):
    pass


class HomogeneousPayload(NoValidRecords):
    pass


class TimestampFormatMismatch(NoValidRecords):
    pass


class UnknownTypeWord(RecordingError):
    pass


class InvalidTypeWord(RecordingError):
    pass


class RecordTruncated(RecordingError):
    pass


class PayloadError(RecordingError):
    pass


class UnknownErrorCode(RecordingError):
    pass


class UnrecoverableSyncLoss(RecordingError):
    exit_code = SYNC_LOSS


class BackwardStep(RecordingError):
    pass


class MergeIncompatible(RecordingError):
    exit_code = INCOMPATIBLE


class UsageError(RecordingError):
    exit_code = USAGE


class ConfigError(RecordingError):
    exit_code = CONFIG


class CalendarError(RecordingError):
    pass


class OutputExists(RecordingError):
    exit_code = USAGE


BY_NAME = {c.__name__: c for c in list(globals().values()) if isinstance(c, type) and issubclass(c, RecordingError)}


def from_status(status: str, detail: str) -> RecordingError:
    return BY_NAME.get(status, RecordingError)(detail)
