"""The driver's tables read as streams, run to what is available now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.session import scratch
from lockstep.sources.ch10 import follow_ch10
from lockstep.streaming.tracker import late_counts, latest_samples, lock_tracker, read_packets_stream, run_available, time_gap_alerts
from lockstep.workload import documents as docs

#: How far a document may come behind the newest one in ``R2_late_packets``, in seconds (twenty documents).
DELAY = 2
#: Longer than any table's documents last, and a clock beyond that (in days).
WHOLE, LATER = 10_000, 40_000
#: A delivery is one trigger, whatever its files: a trigger takes seconds to start and to end, however little it reads.
ALL_FILES = 2**31 - 1


def _stream(spark, sf, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table as a stream, be it one file or a folder of parts (the pattern matches the name itself)."""
    return read_packets_stream(spark, f"{sf}/{name}.parque[t]", docs.table(spark, sf, name).schema, files_per_trigger=files_per_trigger)


def _now(spark, stream: DataFrame) -> DataFrame:
    return run_available(stream, scratch(spark, "live"), scratch(spark, "live-state"))


class _Clock:
    """A folder of clock rows that a tracker reads beside its packets."""

    def __init__(self, spark):
        self.spark, self.path = spark, scratch(spark, "live-clock")
        spark.createDataFrame([], "clock timestamp").write.parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.readStream.schema("clock timestamp").parquet(self.path)

    def move(self, days: int) -> None:
        self.spark.sql(f"SELECT timestamp_seconds({days * 86400}) AS clock").write.mode("append").parquet(self.path)


def read_stream(spark, sf):
    packets = docs.as_packets(_stream(spark, sf, "documents"))
    routed = packets.join(docs.streams(spark).select("stream_id"), "stream_id").select("stream_id", "n_bits")
    return _now(spark, routed).groupBy("stream_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("n_bits").alias("bits"))


def follow_recordings(spark, sf):
    """The documents written as recordings, which a stream finds in their folder."""
    found = _now(spark, follow_ch10(spark, docs.written_recordings(spark, sf), 1 << 20))
    return found.groupBy("channel_id").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.octet_length("payload")).alias("bytes"),
                                           F.max("rel_time_100ns").alias("newest"))


def _flushed(spark, sf) -> DataFrame:
    """Rows of the tracker over all documents in whatever order their files come, with everything given out by a later clock."""
    clock, out, state = _Clock(spark), scratch(spark, "live"), scratch(spark, "live-state")
    rows = None
    for _ in range(2):
        packets = docs.as_packets(_stream(spark, sf, "documents", ALL_FILES))
        rows = run_available(lock_tracker(packets, docs.streams(spark), f"{WHOLE} days", clock.rows()), out, state)
        clock.move(LATER)
    return rows


def _with_frames(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stream_id").agg(F.sum("n_frames").alias("f")).where("f > 0").select("stream_id")


def tracker(spark, sf):
    """All windows of the streams that completed a frame, the last one of each included."""
    samples = latest_samples(_flushed(spark, sf))
    return docs._rounded(samples.join(_with_frames(samples), "stream_id", "left_semi"))


def silent_windows(spark, sf):
    """The last window of every stream that completed a frame, closed by silence alone."""
    rows = _flushed(spark, sf).where("kind in ('closed', 'silent')")
    last = rows.where("kind = 'silent'").join(_with_frames(rows), "stream_id", "left_semi")
    return docs._rounded(last.select("stream_id", "window_idx", "t_abs", "lock_pct", "missed", "n_frames"))


def open_windows(spark, sf):
    """The newest document of every stream, as its last window shows it: still open, or closed by silence."""
    packets = docs.as_packets(_stream(spark, sf, "documents", ALL_FILES))
    rows = _now(spark, lock_tracker(packets, docs.streams(spark), "0 seconds"))
    return rows.where("kind in ('open', 'silent')").groupBy("stream_id").agg(F.max("ord").alias("ord"))


def late(spark, sf):
    """Late documents per language and window when the even ids are delivered first and the odd ones after them: those behind the newest
    even document that the watermark had passed."""
    path, out, state = scratch(spark, "late"), scratch(spark, "live"), scratch(spark, "live-state")
    source = docs.table(spark, sf, "documents")
    rows = None
    for part in (0, 1):
        source.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(path)
        stream = read_packets_stream(spark, path, source.schema, files_per_trigger=ALL_FILES)
        rows = run_available(lock_tracker(docs.as_packets(stream), docs.streams(spark), f"{DELAY} seconds"), out, state)
    return late_counts(rows)


def gap_alerts(spark, sf):
    whole = _stream(spark, sf, "events", ALL_FILES)  # the files need not be in the order of the ids
    times = whole.select(F.col("user_id").cast("int").alias("source_id"), F.col("event_id").alias("file_offset"),
                         (F.unix_micros(F.col("ts").cast("timestamp")) * 10).alias("abs_ticks"))
    return _now(spark, time_gap_alerts(times)).select("source_id", "file_offset", F.round("gap_s", 6).alias("gap_s"))


QUERIES = {"R1_read_packets_stream": read_stream, "R1_follow_ch10": follow_recordings, "R2_late_packets": late, "R3_lock_tracker": tracker, "R4_silent_windows": silent_windows,
           "R4_open_windows": open_windows, "R5_time_gap_alerts": gap_alerts}

_LANGUAGES = ", ".join(f"'{lang}'" for lang in docs.PATTERNS)
ORACLES = {
    "R1_follow_ch10": f"SELECT (list_position([{_LANGUAGES}], lang))::INT AS channel_id, count(*) AS packets, sum(octet_length(encode(text)))::BIGINT AS bytes, "
                      f"max(doc_id) AS newest FROM documents WHERE octet_length(encode(text)) > 0 AND lang IN ({_LANGUAGES}) GROUP BY lang",
    "R1_read_packets_stream": "SELECT lang AS stream_id, count(*) AS packets, sum(8 * octet_length(encode(text)))::BIGINT AS bits FROM documents WHERE octet_length(encode(text)) > 0 GROUP BY lang",
    "R3_lock_tracker": f"{docs._FULL}, done AS (SELECT *, sum(n_frames) OVER (PARTITION BY stream_id) AS f FROM samples) SELECT stream_id, window_idx, t_abs, lock_pct, missed, n_frames FROM done WHERE f > 0",
    "R2_late_packets": f"""WITH p AS (SELECT lang AS stream_id, doc_id AS ord FROM documents WHERE octet_length(encode(text)) > 0 AND lang IN ({_LANGUAGES})),
        m AS (SELECT max(ord) * {docs.DOC_TICKS} - {DELAY} * 10000000 AS mark FROM p WHERE ord % 2 = 0),
        given AS (SELECT stream_id, max(ord) AS newest, min(ord) AS seed FROM p, m WHERE ord % 2 = 0 AND ord * {docs.DOC_TICKS} <= mark GROUP BY 1)
        SELECT p.stream_id, greatest(0, ceil((ord - seed) * {docs.DOC_TICKS} / {docs.PERIOD_TICKS}.0) - 1)::BIGINT AS window_idx, count(*) AS late
        FROM p JOIN given USING (stream_id) WHERE ord % 2 = 1 AND ord < newest GROUP BY ALL""",
    "R4_silent_windows": f"""{docs._FULL} SELECT lang AS stream_id, win AS window_idx, round((seed + win * {docs.PERIOD_TICKS}) / 1e7, 6) AS t_abs,
        round(CASE WHEN bits IS NULL THEN 0.0 ELSE 100.0 * locked::DOUBLE / bits END, 6) AS lock_pct, missed, n_frames
        FROM samples0 JOIN seeds USING (lang) WHERE win = last_win""",
    "R4_open_windows": "SELECT lang AS stream_id, max(doc_id) AS ord FROM documents WHERE octet_length(encode(text)) > 0 GROUP BY 1",
    "R5_time_gap_alerts": "WITH g AS (SELECT user_id AS source_id, event_id AS file_offset, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS d FROM events) SELECT source_id, file_offset, round(d, 6) AS gap_s FROM g WHERE d > 2",
}
