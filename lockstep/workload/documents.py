"""Documents as packets: a language is a stream, a document a packet, its UTF-8 bytes the payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.operators import bits, sync, windows
from lockstep.operators import frames as fr
from lockstep.operators.calibrate import linear_coefficients
from lockstep.operators.config import prepare_streams
from lockstep.plans.calibration import extract_calibration
from lockstep.plans.recording import LockRun, lock_percent, receiver_levels, run_lock
from lockstep.session import scratch
from lockstep.sources.ch10 import PCM, Recording, write_ch10

DOCS_PER_CHUNK = 512
PERIOD_TICKS = 10_000_000
DOC_TICKS = 1_000_000
FRAME_BITS = 800
# Sync text per language, in hex.
PATTERNS = {"en": "206F6620", "fr": "206C6520", "de": "2064656E", "es": "20656C20"}
WORDS = [0, 3, 48]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def packets(spark: SparkSession, sf: str) -> DataFrame:
    return as_packets(table(spark, sf, "documents"))


def as_packets(documents: DataFrame) -> DataFrame:
    payload = F.encode("text", "UTF-8")
    return documents.select(
        F.col("lang").alias("stream_id"), F.col("doc_id").alias("ord"), F.expr(f"doc_id div {DOCS_PER_CHUNK}").alias("chunk"),
        (8 * F.octet_length(payload)).cast("long").alias("n_bits"), (F.col("doc_id") * DOC_TICKS).alias("base_ticks"),
        payload.alias("payload")).where("n_bits > 0")


def streams(spark: SparkSession, rate_clock: bool = False) -> DataFrame:
    rows = [(lang, text, "", FRAME_BITS, 1.0, False, False, False, PERIOD_TICKS, rate_clock) for lang, text in PATTERNS.items()]
    return prepare_streams(spark.createDataFrame(
        rows, "stream_id string, sync_hex string, mask_hex string, bits_in_frame int, data_rate_mbps double, swap_bytes boolean, "
              "inverted boolean, randomized boolean, period_ticks long, use_rate_clock boolean").coalesce(1))


def word_map(spark: SparkSession) -> DataFrame:
    rows = [(lang, i, f"L_RCVR{i + 1}", w) for lang in PATTERNS for i, w in enumerate(WORDS)]
    table_ = spark.createDataFrame(rows, "stream_id string, ord int, name string, word int").coalesce(1)
    slope, offset = linear_coefficients(F.lit(0), F.lit(3), F.lit(20.0))
    return table_.withColumns({"slope": slope, "offset": offset})


def written_recordings(spark, sf) -> str:
    """Documents as PCM packets of one channel per language, written as recordings under the checkpoint folder; the document's number is the
    packet's time."""
    path = scratch(spark, "recordings")
    channel = F.create_map(*[F.lit(x) for i, lang in enumerate(PATTERNS, 1) for x in (lang, i)])
    whole = packets(spark, sf).select(channel[F.col("stream_id")].alias("channel_id"), F.lit(PCM).cast("short").alias("data_type"),
                                      F.col("ord").alias("rel_time_100ns"), "payload")
    write_ch10(whole.where("channel_id is not null"), path)
    return path


def read_recordings(spark, sf):
    """Two channels of the written recordings, of which alone the bodies are read."""
    files = [f.path for f in spark.read.format("binaryFile").load(written_recordings(spark, sf)).select("path").collect()]  # one per writer
    found = Recording(spark, files, 1 << 20).of_type(PCM, [1, 3])
    return found.select("channel_id", F.col("rel_time_100ns").alias("ord"), F.octet_length("payload").alias("bytes"), F.md5(F.hex("payload").cast("binary")).alias("digest"))


def digest(df: DataFrame) -> DataFrame:
    """Payloads as a digest of their hex text."""
    return df.withColumn("digest", F.md5(F.hex("payload").cast("binary"))).drop("payload")


def swap_bytes(spark, sf):
    out = digest(bits.swap_bytes(packets(spark, sf)))
    return out.select("stream_id", "ord", "swap_skipped", "digest")


def swap_report(spark, sf):
    return bits.swap_report(packets(spark, sf))


def invert_bits(spark, sf):
    return digest(bits.invert_bits(packets(spark, sf))).select("stream_id", "ord", "digest")


def derandomize(spark, sf):
    return digest(bits.derandomize(packets(spark, sf))).select("stream_id", "ord", "digest")


def reverse_bits(spark, sf):
    return digest(bits.reverse_bits(packets(spark, sf))).select("stream_id", "ord", "digest")


def sync_hits(spark, sf):
    return bits.sync_hits(packets(spark, sf), streams(spark)).select("stream_id", "bit")


def transform_matrix(spark, sf):
    out = bits.transform_matrix(packets(spark, sf), streams(spark), FRAME_BITS)
    return out.select("stream_id", "swap", "invert", "randomized", "lsb_first", "hits", "on_grid", "rank")


def discover_sync(spark, sf):
    return bits.discover_sync(packets(spark, sf))


def packet_index(spark, sf):
    return windows.packet_index(packets(spark, sf)).select("stream_id", "ord", "seq", "bit_base", "n_bits")


def clock_windows(spark, sf):
    source = packets(spark, sf)
    out = [windows.place_packets(source, streams(spark, clock)).withColumn("rate_clock", F.lit(clock)) for clock in (False, True)]
    return out[0].unionByName(out[1]).select("stream_id", "ord", "rate_clock", "w_first", "w_last", "gap_windows")


def packet_windows(spark, sf):
    placed = windows.place_packets(packets(spark, sf), streams(spark))
    return windows.packet_windows(placed).select("stream_id", "ord", "window_idx", "bit_from", "bit_to", "bits")


def _run(spark, sf) -> LockRun:
    return run_lock(packets(spark, sf), streams(spark))


def lock_anchors(spark, sf):
    return _run(spark, sf).anchors.select("stream_id", "kind", "bit", "count", "locked", "missed", "frame", "boundary")


def lock_spans(spark, sf):
    run = _run(spark, sf)
    return sync.lock_spans(run.anchors, run.chunks, streams(spark))


def missed_frame_events(spark, sf):
    run = _run(spark, sf)
    return sync.missed_frame_events(run.anchors, run.chunks, streams(spark))


def extract_frames(spark, sf):
    run = _run(spark, sf)
    return fr.extract_frames(run.anchors, run.windows).select("stream_id", "start", "end_bit", "window_idx")


def frame_words(spark, sf):
    run = _run(spark, sf)
    words = fr.demux_words(packets(spark, sf), fr.extract_frames(run.anchors), run.chunks, streams(spark), word_map(spark))
    return words.select("stream_id", "end_bit", "word", "name", "raw")


def stream_outcome(spark, sf):
    run = _run(spark, sf)
    out = sync.stream_outcome(packets(spark, sf), run.hits, run.anchors, run.samples)
    return out.select("stream_id", "packets", "bytes", "syncs", "boundary_syncs", "frames", "samples", "verdict")


def _rounded(samples: DataFrame) -> DataFrame:
    return samples.select("stream_id", "window_idx", F.round("t_abs", 6).alias("t_abs"), F.round("lock_pct", 6).alias("lock_pct"), "missed", "n_frames")


def lock_samples(spark, sf):
    return _rounded(lock_percent(packets(spark, sf), streams(spark)))


def levels(spark, sf):
    out = receiver_levels(packets(spark, sf), streams(spark), word_map(spark))
    return out.select("stream_id", "name", "word", "window_idx", F.round("raw_mean", 6).alias("raw_mean"), F.round("value", 6).alias("value"))


def calibration(spark, sf):
    words = word_map(spark).select("stream_id", "ord", "name", "word")
    out = extract_calibration(packets(spark, sf), streams(spark), words, [0.0, 6.0, 12.0])
    return out.select("stream_id", "name", "word", "samples", "outcome", "detected_plateaus", F.round("edge_threshold", 6).alias("edge_threshold"), "period_s")


QUERIES = {
    "S1_read_ch10": read_recordings,
    "E18_extract_calibration": calibration,
    "B1_swap_bytes": swap_bytes, "B1_swap_report": swap_report, "B2_invert_bits": invert_bits, "B3_derandomize": derandomize,
    "B4_reverse_bits": reverse_bits, "B5_sync_hits": sync_hits, "B6_transform_matrix": transform_matrix, "B8_discover_sync": discover_sync,
    "S8_packet_index": packet_index, "W2_clock_windows": clock_windows, "W3_packet_windows": packet_windows, "D1_lock_anchors": lock_anchors,
    "D2_lock_spans": lock_spans, "D3_missed_frame_events": missed_frame_events, "D4_extract_frames": extract_frames,
    "D5_frame_words": frame_words, "D7_stream_outcome": stream_outcome, "W4_lock_percent": lock_samples, "W8_receiver_levels": levels,
}

# --- the same in SQL ------------------------------------------------------------------------------------------------------

_BYTES = """
raw AS (SELECT lang, doc_id, regexp_extract_all(hex(encode(text)), '..') AS hs FROM documents WHERE octet_length(encode(text)) > 0),
flat AS (SELECT lang, doc_id, len(hs) AS size, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS i FROM raw),
bytes AS MATERIALIZED (SELECT lang, doc_id, size, i, ('0x' || h)::INTEGER AS b, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS pos FROM flat)"""


def _digest(value: str, order: str = "i", source: str = "bytes") -> str:
    return (f"WITH {_BYTES} SELECT lang AS stream_id, doc_id AS ord, md5(string_agg(printf('%02X', {value}), '' ORDER BY {order})) AS digest "
            f"FROM {source} GROUP BY lang, doc_id")


_CONFIG = "cfg(lang, pat, len) AS (VALUES " + ", ".join(
    f"('{lang}', {int(text, 16)}::BIGINT, {4 * len(text)})" for lang, text in PATTERNS.items()) + ")"

_HITS = f"""{_CONFIG}, {_BYTES},
near AS (SELECT lang, pos, b + (lag(b, 1, 0) OVER w)::BIGINT * 256 + (lag(b, 2, 0) OVER w)::BIGINT * 65536
         + (lag(b, 3, 0) OVER w)::BIGINT * 16777216 + (lag(b, 4, 0) OVER w)::BIGINT * 4294967296 AS v
         FROM bytes WINDOW w AS (PARTITION BY lang ORDER BY pos)),
hits AS MATERIALIZED (SELECT n.lang, n.pos * 8 + s AS bit FROM near n JOIN cfg USING (lang), range(8) r(s)
         WHERE ((n.v >> (7 - s)) & ((1::BIGINT << len) - 1)) = pat AND n.pos * 8 + s >= len - 1)"""

_PACKETS = f"""
pk0 AS (SELECT lang, doc_id, 8 * octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
pk1 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS seq,
        (doc_id - min(doc_id) OVER (PARTITION BY lang)) * {DOC_TICKS} AS rel, min(doc_id) OVER (PARTITION BY lang) * {DOC_TICKS} AS seed FROM pk0)"""


def _placed(rel: str) -> str:
    return f"""
pk2 AS (SELECT *, greatest(0, ceil(({rel}) / {PERIOD_TICKS}.0) - 1)::BIGINT AS f, greatest(0, ceil(({rel} + (n - 1) * 10) / {PERIOD_TICKS}.0) - 1)::BIGINT AS l FROM pk1),
pk3 AS (SELECT *, max(l) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM pk2),
pk AS (SELECT *, greatest(f, coalesce(reached, 0)) AS w_first, greatest(l, coalesce(reached, 0)) AS w_last, greatest(0, coalesce(f - reached - 1, 0)) AS gap FROM pk3)"""


_SPREAD = f"""
pw0 AS (SELECT *, unnest(range(w_first, w_last + 1)) AS win FROM pk),
pw1 AS (SELECT *, CASE WHEN win = w_last THEN n ELSE least(n, greatest(0, ((win + 1) * {PERIOD_TICKS} - rel) // 10 + 1)) END AS hi,
        CASE WHEN win = w_first THEN 0 ELSE least(n, greatest(0, (win * {PERIOD_TICKS} - rel) // 10 + 1)) END AS lo FROM pw0),
pw AS (SELECT lang, doc_id, win, base + lo AS bit_from, base + hi - 1 AS bit_to, hi - lo AS bits FROM pw1 WHERE hi > lo)"""

_FOLD = f"""
ev0 AS (SELECT lang, bit, 1 AS kind FROM hits UNION ALL SELECT lang, base, 0 FROM pk WHERE gap > 0),
ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY bit, kind) AS rn FROM ev0),
walk AS (
  SELECT lang, 0::BIGINT AS rn, -1::BIGINT AS a, -1 AS c, -1 AS kind, -1::BIGINT AS bit, 0::BIGINT AS locked, 0::BIGINT AS missed, false AS honoured, false AS frame, false AS boundary, -1::BIGINT AS prev
  FROM (SELECT DISTINCT lang FROM ev)
  UNION ALL
  SELECT lang, rn, CASE WHEN honoured THEN bit ELSE a END,
         CASE WHEN kind = 0 THEN -1 WHEN NOT honoured THEN c WHEN boundary THEN least(1, eff + 1) ELSE 1 END, kind, bit,
         CASE WHEN c >= 1 AND kind = 0 THEN greatest(0, least({FRAME_BITS}, bit - 1 - a)) WHEN c >= 1 AND honoured THEN least({FRAME_BITS}, bit - a) ELSE 0 END,
         CASE WHEN honoured THEN (bit - a - 1) // {FRAME_BITS} ELSE 0 END, honoured OR kind = 0, honoured AND boundary AND eff >= 0, honoured AND boundary, a
  FROM (SELECT *, kind = 1 AND NOT (eff >= 1 AND NOT boundary) AS honoured
        FROM (SELECT e.lang, e.rn, e.kind, e.bit, w.a, w.c, (e.bit - w.a) % {FRAME_BITS} = 0 AS boundary,
                     CASE WHEN (e.bit - w.a - 1) // {FRAME_BITS} = 0 THEN w.c ELSE -1 END AS eff
              FROM walk w JOIN ev e ON e.lang = w.lang AND e.rn = w.rn + 1))),
anchors AS MATERIALIZED (SELECT * FROM walk WHERE honoured AND rn > 0),
ends AS (SELECT lang, sum(n)::BIGINT - 1 AS last_bit FROM pk GROUP BY lang),
final AS (SELECT e.lang, last_bit, coalesce(s.a, -1) AS a, coalesce(s.c, -1) AS c FROM ends e LEFT JOIN
          (SELECT lang, arg_max(a, rn) AS a, arg_max(c, rn) AS c FROM walk GROUP BY lang) s USING (lang)),
spans AS (SELECT lang, prev + 1 AS bit_from, prev + locked AS bit_to FROM anchors WHERE locked > 0
          UNION ALL SELECT lang, a + 1, least(a + {FRAME_BITS}, last_bit) FROM final WHERE c >= 1 AND last_bit > a),
lost AS (SELECT lang, prev + j * {FRAME_BITS} + 1 AS bit FROM (SELECT lang, prev, unnest(range(1, missed + 1)) AS j FROM anchors WHERE missed > 0)
         UNION ALL SELECT lang, a + j * {FRAME_BITS} + 1 FROM (SELECT lang, a, unnest(range(1, (last_bit - a - 1) // {FRAME_BITS} + 1)) AS j FROM final))"""

_WINDOWS = f"""
win AS (SELECT lang, win, sum(bits)::BIGINT AS bits, min(bit_from) AS bit_from, max(bit_to) AS bit_to FROM pw GROUP BY lang, win),
frames AS MATERIALIZED (SELECT f.lang, f.prev, f.bit, w.win FROM (SELECT * FROM anchors WHERE frame) f JOIN win w ON f.lang = w.lang AND f.bit BETWEEN w.bit_from AND w.bit_to),
nf AS (SELECT lang, win, count(*) AS n_frames FROM frames GROUP BY lang, win),
lk AS (SELECT w.lang, w.win, sum(least(s.bit_to, w.bit_to) - greatest(s.bit_from, w.bit_from) + 1) AS locked
       FROM win w JOIN spans s ON s.lang = w.lang AND s.bit_from <= w.bit_to AND s.bit_to >= w.bit_from GROUP BY w.lang, w.win),
ms AS (SELECT w.lang, w.win, count(*) AS lost FROM win w JOIN lost s ON s.lang = w.lang AND s.bit BETWEEN w.bit_from AND w.bit_to GROUP BY w.lang, w.win),
ok AS (SELECT lang, max(w.win) AS last_win FROM win w WHERE lang IN (SELECT lang FROM frames) GROUP BY lang),
seeds AS (SELECT lang, any_value(seed) AS seed FROM pk GROUP BY lang),
allw AS (SELECT lang, last_win, unnest(range(0, last_win + 1)) AS win FROM ok),
samples0 AS (SELECT a.lang, a.win, a.last_win, w.bits, coalesce(lk.locked, 0) AS locked, coalesce(n_frames, 0) AS n_frames,
             sum(CASE WHEN w.bits IS NULL THEN {PERIOD_TICKS // 10 // FRAME_BITS} ELSE coalesce(lost, 0) END) OVER (PARTITION BY a.lang ORDER BY a.win)::BIGINT AS missed
             FROM allw a LEFT JOIN win w USING (lang, win) LEFT JOIN lk USING (lang, win) LEFT JOIN nf USING (lang, win) LEFT JOIN ms USING (lang, win)),
samples AS (SELECT lang AS stream_id, win AS window_idx, round((seed + win * {PERIOD_TICKS}) / 1e7, 6) AS t_abs,
            round(CASE WHEN bits IS NULL THEN 0.0 ELSE 100.0 * locked::DOUBLE / bits END, 6) AS lock_pct, missed, n_frames
            FROM samples0 JOIN seeds USING (lang) WHERE win < last_win OR n_frames > 0)"""

_ALL = f"WITH RECURSIVE {_HITS}, {_PACKETS}, {_placed('rel')}, {_SPREAD}, {_FOLD}"
_FULL = f"{_ALL}, {_WINDOWS}"
_WORD_LIST = ", ".join(f"({w}, 'L_RCVR{i + 1}')" for i, w in enumerate(WORDS))
_WORDS = f"""wm(word, name) AS (VALUES {_WORD_LIST}),
want AS MATERIALIZED (SELECT f.lang, f.bit, f.win, word, name, f.prev + 1 + 16 * word AS s FROM frames f, wm),
ahead AS MATERIALIZED (SELECT lang, pos, b * 65536 + (lead(b, 1, 0) OVER w) * 256 + lead(b, 2, 0) OVER w AS v FROM bytes WINDOW w AS (PARTITION BY lang ORDER BY pos)),
got AS (SELECT w.lang, w.bit, w.win, w.word, w.name, (x.v >> (8 - s % 8)) & 65535 AS raw FROM want w JOIN ahead x ON x.lang = w.lang AND x.pos = s // 8)"""

ORACLES = {
    "S1_read_ch10": "SELECT CASE lang WHEN 'en' THEN 1 ELSE 3 END AS channel_id, doc_id AS ord, octet_length(encode(text))::INT AS bytes, md5(hex(encode(text))) AS digest "
                    "FROM documents WHERE lang IN ('en', 'de') AND octet_length(encode(text)) > 0",
    "B1_swap_bytes": f"WITH {_BYTES} SELECT lang AS stream_id, doc_id AS ord, size % 2 = 1 AS swap_skipped, md5(string_agg(printf('%02X', b), '' "
                     "ORDER BY CASE WHEN size % 2 = 1 THEN i WHEN i % 2 = 0 THEN i + 1 ELSE i - 1 END)) AS digest FROM bytes GROUP BY lang, doc_id, size",
    "B1_swap_report": "SELECT *, CASE WHEN skipped = 0 THEN 'swapped' WHEN skipped = packets THEN 'all_odd' ELSE 'mixed' END AS byte_order FROM "
                      "(SELECT lang AS stream_id, count(*) AS packets, count(*) FILTER (octet_length(encode(text)) % 2 = 1) AS skipped "
                      "FROM documents WHERE octet_length(encode(text)) > 0 GROUP BY lang)",
    "B2_invert_bits": _digest("255 - b"),
    "B3_derandomize": f"WITH {_BYTES}, x AS (SELECT *, lag(b, 1, 0) OVER w AS p, lag(b, 2, 0) OVER w AS q FROM bytes WINDOW w AS (PARTITION BY lang ORDER BY pos)) "
                      "SELECT lang AS stream_id, doc_id AS ord, md5(string_agg(printf('%02X', xor(xor(b, (p >> 6) | ((q << 2) & 255)), (p >> 7) | ((q << 1) & 255))), '' ORDER BY i)) "
                      "AS digest FROM x GROUP BY lang, doc_id",
    "B4_reverse_bits": _digest("((b & 1) << 7) | ((b & 2) << 5) | ((b & 4) << 3) | ((b & 8) << 1) | ((b & 16) >> 1) | ((b & 32) >> 3) | ((b & 64) >> 5) | ((b & 128) >> 7)"),
    "B5_sync_hits": f"WITH {_HITS} SELECT lang AS stream_id, bit FROM hits",
    "S8_packet_index": f"WITH {_PACKETS} SELECT lang AS stream_id, doc_id AS ord, seq, base AS bit_base, n AS n_bits FROM pk1",
    "W2_clock_windows": " UNION ALL ".join(
        f"SELECT * FROM (WITH {_PACKETS}, {_placed(rel)} SELECT lang AS stream_id, doc_id AS ord, {flag} AS rate_clock, w_first, w_last, gap AS gap_windows FROM pk)"
        for rel, flag in (("rel", "false"), ("base * 10", "true"))),
    "W3_packet_windows": f"WITH {_PACKETS}, {_placed('rel')}, {_SPREAD} SELECT lang AS stream_id, doc_id AS ord, win AS window_idx, bit_from, bit_to, bits FROM pw",
    "D1_lock_anchors": f'{_ALL} SELECT lang AS stream_id, kind, bit, c AS "count", locked, missed, frame, boundary FROM anchors',
    "D2_lock_spans": f"{_ALL} SELECT lang AS stream_id, bit_from, bit_to FROM spans",
    "D3_missed_frame_events": f"{_ALL} SELECT lang AS stream_id, bit FROM lost",
    "D4_extract_frames": f"{_FULL} SELECT lang AS stream_id, prev AS start, bit AS end_bit, win AS window_idx FROM frames",
    "D5_frame_words": f"{_FULL}, {_WORDS} SELECT lang AS stream_id, bit AS end_bit, word, name, raw FROM got",
    "D7_stream_outcome": f"""{_FULL} SELECT p.lang AS stream_id, packets, bytes, coalesce(syncs, 0) AS syncs, coalesce(bs, 0) AS boundary_syncs, coalesce(fr, 0) AS frames,
        coalesce(sm, 0) AS samples, CASE WHEN coalesce(syncs, 0) = 0 THEN 'no_sync' WHEN coalesce(fr, 0) = 0 THEN 'sync_no_frames' ELSE 'ok' END AS verdict
        FROM (SELECT lang, count(*) AS packets, sum(n // 8)::BIGINT AS bytes FROM pk GROUP BY lang) p LEFT JOIN (SELECT lang, count(*) AS syncs FROM hits GROUP BY lang) USING (lang)
        LEFT JOIN (SELECT lang, count(*) FILTER (boundary) AS bs, count(*) FILTER (frame) AS fr FROM anchors GROUP BY lang) USING (lang)
        LEFT JOIN (SELECT stream_id AS lang, count(*) AS sm FROM samples GROUP BY stream_id) USING (lang)""",
    "W4_lock_percent": f"{_FULL} SELECT stream_id, window_idx, t_abs, lock_pct, missed, n_frames FROM samples",
    "W8_receiver_levels": f"""{_FULL}, {_WORDS}, sums AS (SELECT lang, win, word, avg(raw) AS m FROM got GROUP BY lang, win, word)
        SELECT stream_id, name, word, window_idx, round(coalesce(m, 0.0), 6) AS raw_mean, round(CASE WHEN n_frames > 0 THEN coalesce(m, 0.0) * (100.0 / 65535) ELSE 0.0 END, 6) AS value
        FROM samples s CROSS JOIN wm LEFT JOIN (SELECT lang AS stream_id, win AS window_idx, word, m FROM sums) USING (stream_id, window_idx, word)""",
}

# Seven bytes of a stream as one number W; the pattern is looked for in its last five. Descrambling is W with its own bits 14 and 15 back.
ORACLES["B6_transform_matrix"] = f"""WITH {_CONFIG}, {_BYTES},
flag(f) AS (VALUES (false), (true)),
moved AS (SELECT lang, f AS swap, pos + CASE WHEN f AND size % 2 = 0 THEN 1 - i % 2 * 2 ELSE 0 END AS pos, b::BIGINT AS b FROM bytes, flag),
near AS (SELECT lang, swap, pos, b + {" + ".join(f"(lag(b, {k}, 0::BIGINT) OVER w) * {256 ** k}" for k in range(1, 7))} AS v FROM moved WINDOW w AS (PARTITION BY lang, swap ORDER BY pos)),
i AS (SELECT lang, swap, pos, f AS invert, CASE WHEN f THEN xor(v, (1::BIGINT << (8 * least(pos + 1, 7))::INT) - 1) ELSE v END AS v FROM near, flag),
r AS (SELECT lang, swap, pos, invert, f AS randomized, CASE WHEN f THEN xor(xor(v, v >> 14), v >> 15) ELSE v END & {2 ** 40 - 1} AS v FROM i, flag),
r4 AS (SELECT *, ((v & {0x0F0F0F0F0F}) << 4) | ((v >> 4) & {0x0F0F0F0F0F}) AS a FROM r),
r2 AS (SELECT *, ((a & {0x3333333333}) << 2) | ((a >> 2) & {0x3333333333}) AS c FROM r4),
m AS (SELECT lang, swap, pos, invert, randomized, f AS lsb_first, CASE WHEN f THEN ((c & {0x5555555555}) << 1) | ((c >> 1) & {0x5555555555}) ELSE v END AS v FROM r2, flag),
found AS (SELECT lang, swap, invert, randomized, lsb_first, pos * 8 + s AS bit FROM m JOIN cfg USING (lang), range(8) t(s)
          WHERE ((v >> (7 - s)) & ((1::BIGINT << len) - 1)) = pat AND pos * 8 + s >= len - 1),
res AS (SELECT lang, swap, invert, randomized, lsb_first, bit % {FRAME_BITS} AS x, count(*) AS n FROM found GROUP BY ALL),
per AS (SELECT lang, swap, invert, randomized, lsb_first, sum(n)::BIGINT AS hits, max(n) AS top FROM res GROUP BY ALL),
every AS (SELECT lang, a.f AS swap, b.f AS invert, c.f AS randomized, d.f AS lsb_first FROM cfg, flag a, flag b, flag c, flag d),
joined AS (SELECT every.*, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) < 2 THEN 0 ELSE top END AS on_grid FROM every LEFT JOIN per USING (lang, swap, invert, randomized, lsb_first))
SELECT lang AS stream_id, swap, invert, randomized, lsb_first, hits, on_grid,
       row_number() OVER (PARTITION BY lang ORDER BY on_grid DESC, hits DESC, swap, invert, randomized, lsb_first) AS rank FROM joined"""
