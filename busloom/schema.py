"""Fixed values of bus recordings, and the schemas of their tables."""

from __future__ import annotations

#: Message types by code (fixed values).
MESSAGE_TYPES = {0x01: "MODE_COMMAND", 0x02: "BC_TO_RT", 0x04: "RT_TO_BC", 0x08: "RT_TO_RT", 0x10: "BROADCAST_BC_TO_RT", 0x18: "BROADCAST_RT_TO_RT", 0x20: "SPURIOUS_DATA"}
#: Message formats by number (fixed values).
MESSAGE_FORMATS = {1: "RECEIVE", 2: "TRANSMIT", 3: "RT_TO_RT", 4: "RECEIVE_BROADCAST", 5: "RT_TO_RT_BROADCAST", 6: "MODE_CODE_TX_DATA", 7: "MODE_CODE_RX_DATA", 8: "MODE_CODE_NO_DATA", 9: "MODE_CODE_BCAST_NO_DATA", 10: "MODE_CODE_BCAST_DATA", 11: "SPURIOUS_DATA"}
#: Error codes of the recording card, and the two that pairing adds (fixed values).
CARD_ERROR_CODES = (0x011E, 0x0120, 0x0136, 0x0140, 0x0150)
CONTINUATION, STANDALONE = 0x2000, 0x2001

SPURIOUS_TYPE, SPURIOUS_FORMAT = 0x20, 11
MAX_DATA_WORDS = 32
MICROS_PER_DAY = 86_400_000_000

#: What a source gives: rows of kind 'rec' with words after the timestamp, markers of kind 'resync', and one 'status' row. The
#: last columns tell what is known of a record from those before it: the words of the errored record that it continues, its
#: stamp (microseconds or a counter; that of its parent), the last stamp of its key, the highest so far, and whether it is back in time.
RAW = "file_index int, source_path string, seq bigint, file_offset bigint, kind string, ts_format string, type_word int, t0 int, t1 int, t2 int, body array<int>, mux string, detail string, parent array<int>, stamp bigint, prev_stamp bigint, high bigint, back boolean"

#: Public fields of a decoded record, in order.
FIELDS = ("file_offset", "timestamp", "time_us", "ticks", "freerun", "day_of_year", "time_of_day_us", "datetime", "message_type", "message_format", "bus", "error", "rt", "subaddress", "direction", "msg_label", "command_word", "command_word_2", "status_word", "status_word_2", "error_word", "data_word_count", "data_words", "delta", "mux")

#: Columns of the CSV table: fixed names and order.
CSV_COLUMNS = ("TIME_STAMP", "RT", "MSG", *(f"WD{i:02d}" for i in range(1, 33)), "STAT", "CMD", "MUX", "TERM_NAME", "BUS", "DELTA", "IM_GAP", "RCV_GAP", "XMT_GAP", "ERROR", "ERROR_CODE")
