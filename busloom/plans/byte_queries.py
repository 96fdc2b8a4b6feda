"""Queries that frame bytes: recordings are packed from the events table, damaged in known ways, and read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decode as decoding
from ..operators import delta, dump, filters, merge, pairing
from ..shared import shared_dir
from ..sources import index
from ..sources.recording import read_bytes, read_files
from ..sources.selection import Selection
from . import byteview as V


def _recs(df: DataFrame) -> DataFrame:
    return df.filter("kind = 'rec'")


def _status(df: DataFrame, *more: str) -> DataFrame:
    """How each file ended, and more columns of df."""
    get = lambda k: F.get_json_object("detail", f"$.{k}")
    told = F.size(F.from_json(get("warnings"), "array<string>"))
    s = df.filter("kind = 'status'")
    return s.select("file_index", get("state").alias("state"), get("records").cast("long").alias("records"), get("sync_losses").cast("long").alias("sync_losses"), get("ts_format").alias("ts_format"), get("stop_offset").cast("long").alias("stop_offset"), told.cast("long").alias("n_warnings"), *more)


def register(query) -> None:
    """Add the queries by a decorator that takes their SQL."""
    sql = V.SQL_CLIPS
    end = "0000"

    @query(f"with {sql} select f file_index, cast(p as bigint) seq, 2 * (coalesce(sum(n + 6) over w, 0))::bigint file_offset, tw type_word, cast(n + 2 as integer) n_words, cast(cmd as integer) command, 'CH' || (f % 5) mux, 'irig' ts_format from t window w as (partition by f order by e rows between unbounded preceding and 1 preceding)")
    def frame_records(spark, sf_dir):
        """Little-endian words, lengths from type words, the terminator, and the multiplexer of a file's name."""
        name = F.concat(F.lit("a.b.c.d.CH"), F.col("f") % 5, F.lit(".rec"))
        raw = _recs(read_bytes(V.files(V.clips(spark, sf_dir), V.record(), end, name)))
        return raw.select("file_index", "seq", "file_offset", "type_word", F.size("body").alias("n_words"), F.get("body", F.lit(0)).alias("command"), "mux", "ts_format")

    lead = "case when p = 0 then f % 50 else 0 end"

    @query(f"with {sql}, j as (select *, {lead} junk from t) select f file_index, min(o) first_offset, count(*) records from (select f, p, 2 * sum(junk + n + 6) over (partition by f order by e) - 2 * (n + 6) o from j) group by f")
    def frame_first_record(spark, sf_dir):
        """The first record behind words that are none."""
        first = F.when(F.col("p") == 0, F.col("f") % 50).otherwise(0)
        raw = _recs(read_bytes(V.files(V.clips(spark, sf_dir), F.concat(V.junk(first), V.record()), end)))
        return raw.groupBy("file_index").agg(F.min("file_offset").alias("first_offset"), F.count("*").alias("records"))

    @query(f"with {sql}, o as (select *, 2 * (coalesce(sum(n + 6) over (partition by f order by e rows between unbounded preceding and 1 preceding), 0) + 6 * 3)::bigint o from t) select f file_index, case when f % 3 = 0 then cast(0 as bigint) else min(o) end first_offset from o group by f")
    def frame_lookahead(spark, sf_dir):
        """Three decoys that look like records go before the first: they are believed where nothing behind them is looked at."""
        decoy = F.concat(*(V.word(x) for x in (0x0602, 10 * 32 + 3, 0x7F, 0x7F, 0x7F7F, 0x7F7F)))  # six words; followed by another, or by words that are none
        rows = V.clips(spark, sf_dir)
        lead = F.when(F.col("p") == 0, F.when(F.col("f") % 3 == 0, F.flatten(F.array_repeat(decoy, 3))).otherwise(F.flatten(F.array(*[F.concat(F.slice(decoy, 1, 5), V.word(V.JUNK))] * 3)))).otherwise(F.array().cast("array<int>"))
        lead = F.when((F.col("p") == 0) & (F.col("f") % 3 != 0), F.transform(lead, lambda w: F.when(w == 0x0602, 0x0502).otherwise(w))).otherwise(lead)
        raw = _recs(read_bytes(V.files(rows, F.concat(lead, V.record()), end)))
        return raw.groupBy("file_index").agg(F.min("file_offset").alias("first_offset"))

    hurt = "p > 1 and e % 13 = 5"
    losses = f"""with {sql}, j as (select *, case when {hurt} then 1 + e % 9 else 0 end junk, case when {hurt} then 1 else 0 end lost from t),
      o as (select *, 2 * sum(junk + n + 6) over w - 2 * (n + 6) o, sum(lost) over w losses from j window w as (partition by f order by e))"""

    def damaged(spark, sf_dir):
        rows = V.clips(spark, sf_dir)
        between = F.when((F.col("p") > 1) & (F.col("e") % 13 == 5), 1 + F.col("e") % 9).otherwise(0)
        return read_bytes(V.files(rows, F.concat(V.junk(between), V.record()), end))

    @query(f"""{losses} select f file_index, cast(p + losses as bigint) seq, cast(o as bigint) file_offset, 'rec' kind, cast(null as varchar) detail from o
      union all select f, cast(p + losses - 1 as bigint), cast(o - 2 * junk as bigint), 'resync', printf('0x%X: unknown message type', cast(o as bigint)) from o where junk > 0""")
    def frame_recovery(spark, sf_dir):
        """Words between records: each loss of sync has a marker with the place at which reading goes on."""
        return damaged(spark, sf_dir).filter("kind <> 'status'").select("file_index", "seq", "file_offset", "kind", "detail")

    @query(f"{losses} select f file_index, case when max(losses) > 0 then 'partial-recovered' else 'complete' end state, count(*) records, cast(max(losses) as bigint) sync_losses, 'irig' ts_format, cast(max(o + 2 * (n + 6)) as bigint) stop_offset, cast(least(max(losses), 8) as bigint) n_warnings from o group by f")
    def frame_loss_counts(spark, sf_dir):
        return _status(damaged(spark, sf_dir))

    sizes = f"with {sql}, z as (select f, cast(2 * sum(n + 6) as bigint) size, cast(2 * max_by(n + 6, e) as bigint) last, count(*) k from t group by f)"

    @query(f"""{sizes} select f file_index, case when f % 4 = 2 then 'truncated-tail' else 'complete' end state, case when f % 4 = 2 then k - 1 else k end records, cast(0 as bigint) sync_losses, 'irig' ts_format,
      case when f % 4 = 2 then size - last else size end stop_offset, cast(case when f % 4 in (2, 3) then 1 else 0 end as bigint) n_warnings from z""")
    def frame_tails(spark, sf_dir):
        """Files that end with a terminator, without one, inside a record, or with words behind the terminator."""
        kind = F.col("f") % 4
        tail = F.when(kind == 0, "0000").when(kind == 3, "0000" + "FFFF" * 6).otherwise("")
        return _status(read_bytes(V.files(V.clips(spark, sf_dir), V.record(), tail, cut=F.when(kind == 2, 4).otherwise(0))))

    @query("""with z as (select distinct cast(event_id // 40 as integer) f from events) select f file_index, case f % 4 when 0 then 'EmptyFile' when 1 then 'empty-recording' when 2 then 'NoValidRecords' else 'HomogeneousPayload' end state, cast(0 as bigint) records,
      case when f % 4 = 1 then cast(1 as bigint) else cast(0 as bigint) end n_warnings from z""")
    def frame_refused(spark, sf_dir):
        """No bytes, nothing but a terminator, text, and one record again and again."""
        kind = F.col("f") % 4
        text = F.when(kind == 0, "").when(kind == 1, "0000").when(kind == 2, F.hex(F.lit("nothing-but-text." * 8))).otherwise("02064301100C7F000AFF7F7F" * 6)
        rows = V.clips(spark, sf_dir).select("f").distinct().select(F.col("f").alias("file_index"), F.lit("x").alias("name"), F.unhex(text).alias("content"))
        return _status(read_bytes(rows)).select("file_index", "state", "records", "n_warnings")

    wrong_time = f"""with {sql}, j as (select *, case when p in (9, 17, 30) then p end bad, 2 * (coalesce(sum(n + 6) over (partition by f order by e rows between unbounded preceding and 1 preceding), 0))::bigint o, lead(p) over (partition by f order by e) nxt from t)"""

    @query(f"{wrong_time} select f file_index, cast(count(*) - count(bad) as bigint) records, cast(count(bad) as bigint) sync_losses, cast(sum(case when bad is null then o else 0 end) as bigint) offsets from j group by f having max(p) >= 31")
    def frame_time_ranges(spark, sf_dir):
        """Hours, minutes, seconds, microseconds and days out of range cost a record each; a free-running clock may have any day."""
        rows = V.clips(spark, sf_dir)
        whole = rows.groupBy("f").agg(F.max("p").alias("most")).filter("most >= 31").select(F.col("f").alias("g"))
        rows = rows.join(F.broadcast(whole), F.col("f") == F.col("g"), "left_semi")
        p, k = F.col("p"), F.col("f") % 4
        up = F.when(p == 9, F.when(k == 0, 10 * 32 + 24).when(k == 1, 367 * 32 + 3).otherwise(10 * 32 + 31)).when(p == 20, 32768 + 450 * 32 + 3).otherwise(10 * 32 + 3)
        mid = F.when(p == 17, F.when(k == 0, 60 * 1024).otherwise(63 * 1024)).otherwise(F.col("minute") * 1024 + F.col("second") * 16)
        mid = F.when(p == 30, 30 * 1024 + 15).otherwise(mid)
        low = F.when(p == 30, 65535).otherwise(F.col("micro"))
        raw = read_bytes(V.files(rows, V.record(time=F.concat(V.word(up), V.word(mid), V.word(low))), end))
        # one pass over the rows: files would be framed twice for a join
        told = F.max(F.when(F.col("kind") == "status", F.col("detail")))
        got = raw.groupBy("file_index").agg(F.sum(F.when(F.col("kind") == "rec", F.col("file_offset"))).alias("offsets"), told.alias("detail"))
        status = _status(got.withColumn("kind", F.lit("status")), "offsets")
        return status.filter("offsets is not null").select("file_index", "records", "sync_losses", "offsets")

    @query(f"""{sizes} select f file_index, case f % 4 when 0 then 'UnknownTypeWord' when 1 then 'InvalidTypeWord' when 2 then 'RecordTruncated' else 'PayloadError' end state, case when f % 4 = 2 then k - 1 else k end records, cast(1 as bigint) sync_losses,
      case when f % 4 = 2 then size - last else size end stop_offset from z""")
    def frame_strict(spark, sf_dir):
        """What strict reading stops at: an unknown type, a length no record can have, a record cut short, and a time out of range."""
        kind = F.col("f") % 4
        tail = F.when(kind == 0, "FFFF" * 8).when(kind == 1, "0203" + "FFFF" * 8).when(kind == 3, "0206" + "5801" + "7F00" * 4 + "0000").otherwise("")
        return _status(read_bytes(V.files(V.clips(spark, sf_dir), V.record(), tail, cut=F.when(kind == 2, 4).otherwise(0)), strict="true")).select("file_index", "state", "records", "sync_losses", "stop_offset")

    @query(f"{sizes} select f file_index, 'UnrecoverableSyncLoss' state, k records, cast(1 as bigint) sync_losses, size stop_offset from z where f % 16 = 3")
    def frame_unrecoverable(spark, sf_dir):
        """No record within 64 KiB of a loss."""
        far = F.expr("repeat('FF7F', 36000)")
        return _status(read_bytes(V.files(V.clips(spark, sf_dir), V.record(), far, keep=F.col("f") % 16 == 3))).select("file_index", "state", "records", "sync_losses", "stop_offset")

    probes = "with z as (select cast(event_id // 40 as integer) f, count(*) k from events group by 1)"

    def counters(spark, sf_dir, **options):
        """Files with counters and with calendar times, in turn."""
        odd = F.col("f") % 2 == 1
        time = F.when(odd, V.counter()).otherwise(V.stamp())
        return read_bytes(V.files(V.clips(spark, sf_dir), V.record(time=time), end), **options)

    @query(f"{probes} select f file_index, case when f % 2 = 1 then 'standard' else 'irig' end ts_format, k records, cast(0 as bigint) n_warnings from z")
    def probe_formats(spark, sf_dir):
        """The time format, told from the records."""
        return _status(counters(spark, sf_dir)).select("file_index", "ts_format", "records", "n_warnings")

    @query(f"{probes} select f file_index, case when f % 2 = 1 then 'complete' else 'TimestampFormatMismatch' end state from z")
    def probe_forced_strict(spark, sf_dir):
        """Counters asked for; where calendar times are decisive, strict reading refuses the file."""
        return _status(counters(spark, sf_dir, input_time_format="standard", strict="true")).select("file_index", "state")

    @query(f"{probes} select f file_index, 'standard' ts_format, cast(case when f % 2 = 1 then 0 else 1 end as bigint) told from z")
    def probe_forced(spark, sf_dir):
        got = counters(spark, sf_dir, input_time_format="standard")
        return got.filter("kind = 'status'").select("file_index", "ts_format", F.col("detail").contains("is decisive").cast("long").alias("told"))

    @query(f"with {sql} select f file_index, cast(p as bigint) seq, case when f % 2 = 1 then e * 1280 + 127 end ticks, case when f % 2 = 1 then cast(round((e * 1280 + 127) * 1e6 / 500000.0::double) as bigint) else us end time_us from t")
    def counter_times(spark, sf_dir):
        """Counters and calendar times side by side, with a rate for the former. Counters wrap every 3.4 million events; files are known to begin at a tick."""
        began = F.col("file_index").cast("long") * (V.EVENTS_OF_FILE * V.TICKS)
        return pairing.pair(decoding.decode(counters(spark, sf_dir), tick_rate_hz=500_000.0, began=began)).select("file_index", "seq", "ticks", "time_us")

    @query(f"""with {sql}, q as (select f, case when f % 3 = 0 and f % 2 = 0 then true else false end free, case when f % 2 = 1 then 'standard' else 'irig' end ts from t group by all) select f file_index, ts ts_format, case when ts = 'irig' then free end freerun from q where ts <> 'irig' or free""")
    def merge_incompatible(spark, sf_dir):
        """Files that no merge can take: they open with a counter, or with a clock that runs free."""
        odd = F.col("f") % 2 == 1
        time = F.when(odd, V.counter()).otherwise(V.stamp((F.col("f") % 3 == 0) & (F.col("p") < 5)))
        raw = read_bytes(V.files(V.clips(spark, sf_dir), V.record(time=time), end))
        return merge.incompatible(pairing.pair(decoding.decode(raw)))

    _layouts(query, sql, end)

    @query("select cast(page_id as integer) file_index, case when len(string_split(url, '.')) > 1 then nullif(trim(string_split(replace(url, '/', '|'), '.')[2], ' \t'), '') end mux from pages")
    def mux_from_name(spark, sf_dir):
        """A field of a file's name; the pages' addresses serve as names."""
        pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
        one = "02080301000C7F000118" + "7F7F" * 2 + "0008"
        named = pages.select(F.col("page_id").cast("int").alias("file_index"), F.translate("url", "/", "|").alias("name"), F.unhex(F.lit(one)).alias("content"))
        return read_bytes(named, mux_field="1").filter("kind = 'status'").select("file_index", "mux")

    @query(f"""with {sql}, o as (select f, p, e, tw, 2 * (coalesce(sum(n + 6) over (partition by f order by e rows between unbounded preceding and 1 preceding), 0))::bigint o, n, dir from t)
      select f file_index, printf('0x%08X: %s bus %s %d words (type word 0x%04X)', o, case when dir = 0 then 'BC_TO_RT' else 'RT_TO_BC' end, case when e % 2 = 1 then 'B' else 'A' end, n + 6, tw) line from o where p < 7""")
    def dump_limit(spark, sf_dir):
        """The first lines of a file's first records, as a dump tells them."""
        lines = dump.lines_of(V.files(V.clips(spark, sf_dir), V.record(), end), records=7)
        return lines.filter("line like '0x%'").select("file_index", "line")


def _layouts(query, sql: str, end) -> None:
    """All eleven layouts of a record, errors, continuations and rejections."""
    #: Layout by e % 16: 0-4 the plain types, 5-9 mode codes, 10 and 11 an error and its continuation, 12 spurious, 13-15 rejected.
    base = f"""{sql}, k as (select *, e % 16 m, case when e % 16 in (3, 4, 9, 8) then 31 else rt end r2, rt * 2048 st, ((rt + 1) % 31) * 2048 + sa * 32 + n cmd2,
      [cast((e * 31 + j * 17) % 512 * 128 + 127 as integer) for j in range(0, n)] d from c),
    m as (select *, case m when 0 then 2 when 1 then 4 when 2 then 8 when 3 then 16 when 4 then 24 when 10 then 2 when 11 then 32 when 12 then 32 when 13 then 2 when 14 then 4 when 15 then 8 else 1 end code from k)"""

    def layouts(spark, sf_dir):
        rows = V.clips(spark, sf_dir)
        m = F.col("e") % 16
        mode = m.between(5, 9)
        rt = F.when(m.isin(3, 4, 8, 9), 31).otherwise(F.col("rt"))
        transmit = F.when(m.isin(1, 2, 4, 5, 13), 1).when(m.isin(14), 0).otherwise(0)
        sa = F.when(mode, 31).otherwise(F.col("sa"))
        cmd = V.word(rt * 2048 + transmit * 1024 + sa * 32 + F.col("n"))
        status, data = V.word(F.col("rt") * 2048), V.data()
        receiver = (F.col("rt") + 1) % 31
        second = V.word(receiver * 2048 + F.col("sa") * 32 + F.col("n") + (m == 15).cast("int"))
        one = F.slice(data, 1, 1)
        code = F.when(m == 0, 2).when(m == 1, 4).when(m.isin(2, 15), 8).when(m == 3, 16).when(m == 4, 24).when(mode, 1).when(m.isin(10, 13), 2).when(m == 14, 4).otherwise(32)
        rest = (
            F.when(m.isin(0, 13), F.concat(cmd, data, status)).when(m.isin(1, 14), F.concat(cmd, status, data)).when(m.isin(2, 15), F.concat(cmd, second, status, data, V.word(receiver * 2048))).when(m == 3, F.concat(cmd, data))
            .when(m == 4, F.concat(cmd, second, status, data)).when(m == 5, F.concat(cmd, status, one)).when(m == 6, F.concat(cmd, one, status)).when(m == 7, F.concat(cmd, status)).when(m == 8, cmd).when(m == 9, F.concat(cmd, one))
            .when(m == 10, F.concat(cmd, data, V.word(0x0140))).otherwise(data)
        )
        return decoding.decode(read_bytes(V.files(rows, V.record(code, None, rest, m == 10), end)))

    words = "case m when 8 then cast([] as integer[]) when 7 then cast([] as integer[]) when 5 then d[1:1] when 6 then d[1:1] when 9 then d[1:1] else d end"

    @query(f"""with {base} select f file_index, cast(p as bigint) seq, cast(case m when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 5 when 5 then 6 when 6 then 7 when 7 then 8 when 8 then 9 when 9 then 10 when 10 then 1 else 11 end as integer) message_format,
      cast(case when m in (0, 1, 2, 4, 5, 6, 7) then st end as integer) status_word, cast(case when m = 2 then ((rt + 1) % 31) * 2048 end as integer) status_word_2, cast(case when m in (2, 4) then cmd2 end as integer) command_word_2, {words} data_words from m where m < 13""")
    def payload_layouts(spark, sf_dir):
        """Command, status and data words of all eleven layouts."""
        return layouts(spark, sf_dir).filter("kind = 'rec'").select("file_index", "seq", "message_format", "status_word", "status_word_2", "command_word_2", "data_words")

    @query(f"""with {base} select f file_index, cast(p as bigint) seq, case m when 13 then 'direction-bc-to-rt' when 14 then 'direction-rt-to-bc' else 'data-word-count-mismatch' end reject_reason from m where m >= 13""")
    def payload_rejected(spark, sf_dir):
        """Records whose words contradict each other."""
        return layouts(spark, sf_dir).filter("kind = 'skip'").select("file_index", "seq", "reject_reason")

    @query(f"""with {base}, s as (select *, cast(10 as bigint) * 86400000000 + cast(3 as bigint) * 3600000000 + cast(p as bigint) * 60000000 + "second" * 1000000 + micro us, lag(m) over w before from m window w as (partition by f order by e)),
      b as (select *, lag(us) over (partition by f order by e) parent_us from s)
      select f file_index, cast(p as bigint) seq, cast(case when m = 10 then 320 when m = 11 and before = 10 then 8192 else 8193 end as integer) error_word, case when m = 11 and before = 10 then parent_us else us end time_us from b where m in (10, 11, 12)""")
    def payload_errors(spark, sf_dir):
        """Errored records, the words behind them that continue them, and those that stand alone."""
        got = pairing.pair(layouts(spark, sf_dir))
        return got.filter("error_word is not null").select("file_index", "seq", "error_word", "time_us")

    @query(f"""with {base}, s as (select *, cast(10 as bigint) * 86400000000 + cast(3 as bigint) * 3600000000 + cast(p as bigint) * 60000000 + "second" * 1000000 + micro us, r2 rt3, case when m in (5, 6, 7, 8, 9) then 31 else sa end sa3, case when m in (1, 2, 4, 5) then 1 else 0 end dir3 from m where m < 13 and m not in (11, 12)),
      g as (select *, lag(us) over (partition by f, rt3, sa3, dir3 order by e) prev from s) select f file_index, cast(p as bigint) seq, cast(coalesce(us - prev, 0) as bigint) delta_us from g""")
    def delta_from_bytes(spark, sf_dir):
        """Gaps since a key was last seen, rejected records aside, as the framer tells them."""
        return delta.with_delta(pairing.pair(layouts(spark, sf_dir))).filter("rt is not null").select("file_index", "seq", "delta_us")

    def pieces(spark, sf_dir, select=None):
        """Recordings in files, read in pieces of 4 kB."""
        paths = V.put(V.files(V.long_clips(spark, sf_dir), V.record(), end))
        return read_files(spark, paths, 4096, select, input_time_format="irig")

    long = V.SQL_LONG

    @query(f"with {long} select f file_index, cast(p as bigint) seq, 2 * (coalesce(sum(n + 6) over w, 0))::bigint file_offset, cast(code + (e % 2) * 128 + (n + 6) * 256 as integer) type_word, us stamp from l window w as (partition by f order by e rows between unbounded preceding and 1 preceding)")
    def pieces_records(spark, sf_dir):
        """Files read in pieces: numbers and offsets go on from piece to piece."""
        return _recs(pieces(spark, sf_dir)).select("file_index", "seq", "file_offset", "type_word", "stamp")

    day = 10 * 86_400_000_000
    since, until = day + 5 * 3_600_000_000, day + 7 * 3_600_000_000 + 90_000_000
    gaps = f"with {long}, g as (select *, us - lag(us) over (partition by f, rt, sa, dir order by e) gap from l)"

    @query(f"{gaps} select f file_index, cast(p as bigint) seq, us time_us, cast(rt as integer) rt, cast(coalesce(gap, 0) as bigint) delta_us from g where us >= {since} and us < {until}")
    def pieces_time_range(spark, sf_dir):
        """A range of time: only pieces that overlap it are opened. Gaps go back to records that aren't read."""
        chosen = pieces(spark, sf_dir, Selection.of(None, since, until))
        got = delta.with_delta(pairing.pair(decoding.decode(chosen))).filter(F.col("time_us").between(since, until - 1))
        return got.select("file_index", "seq", "time_us", "rt", "delta_us")

    asked = filters.Filters(exclude_types=(0x04,), include_rts=(3, 5, 8, 13, 21), exclude_subaddresses=(7, 11))

    @query(f"{gaps} select f file_index, cast(p as bigint) seq, us time_us, cast(rt as integer) rt, cast(sa as integer) subaddress, cast(coalesce(gap, 0) as bigint) delta_us from g where code <> 4 and rt in (3, 5, 8, 13, 21) and sa not in (7, 11)")
    def pieces_filtered(spark, sf_dir):
        """Message filters at the source: what they drop never becomes a row."""
        got = delta.with_delta(pairing.pair(decoding.decode(pieces(spark, sf_dir, Selection.of(asked)))))
        return got.select("file_index", "seq", "time_us", "rt", "subaddress", "delta_us")

    @query(f"with {long}, o as (select *, 2 * (coalesce(sum(n + 6) over (partition by f order by e rows between unbounded preceding and 1 preceding), 0))::bigint o from l) select f file_index, cast(p as bigint) seq, o file_offset, us stamp, cast(rt as integer) rt from o where p between 700 and 719")
    def index_window(spark, sf_dir):
        """Twenty records from number 700 on of each recording, found by a kept index: the other pieces aren't opened."""
        paths = V.put(V.files(V.long_clips(spark, sf_dir), V.record(), end))
        folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        index.write_index(spark, paths, folder, 4096, input_time_format="irig")
        got = _recs(index.read_indexed(spark, folder, paths=paths, first=700, until=720))
        return decoding.decode(got.withColumn("at", F.col("stamp"))).select("file_index", "seq", "file_offset", F.col("at").alias("stamp"), "rt")
