"""Lock samples from a stream of packets, by two stateful operators and an event-time watermark.

Packets may come in any order within ``delay``. The first operator is keyed by stream and chunk (a byte range of the file, so its packets are
bounded): it holds slim packets - a few numbers, the hits found inside, the first and last bits; payloads end before it - until the watermark
has passed them, and then gives out one piece: its packets in order, hits across their borders found, one row however many they are. The second
is keyed by stream: it takes the pieces that became due, puts them into a map state, and folds them in order one by one. So no task holds a
stream's packets of a trigger, and what arrived shuffled is placed, not only reported.

Four kinds of rows leave it. ``closed``: a window that a later packet ended. ``silent``: a window whose end the watermark has passed, closed by
an event-time timer without another packet; a stream that stops gives out its last window that way. ``open``: the window that is filling, as
it stands after a trigger; a later row of the window replaces it. ``late``: a packet behind the newest one folded, with the window that it
belongs to; it is kept out of the samples. (One that is the newest in order but older than a window that silence closed counts in the next
window, as times that run backwards do in a batch.)

The watermark is the newest time of any packet of any stream, less ``delay``. Slim packets carry no event time of their own (a late one would
be dropped unseen); a clock row per batch of packets, or per row of ``ticks`` (say, a recording's time packets), moves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from lockstep.functions import bits as kernels
from lockstep.operators.scans import per_stream
from lockstep.operators.sync import ANCHOR, NO_LOCK, fold_hits
from lockstep.sources.recording import GAP_TICKS, route_packets

OUTPUT = "stream_id string, window_idx long, t_abs double, lock_pct double, missed long, n_frames long, kind string, ord long"
CLOSED, SILENT, OPEN, LATE = "closed", "silent", "open", "late"
PIECE = "piece"
_STATE = ("last_ord long, bit_base long, tail string, anchor long, count int, locked long, missed long, frames long, expected long, seed long, "
          "window long, window_bits long, base_locked long, base_frames long, silent long")
_CONFIG = {"pattern": LongType(), "mask": LongType(), "sync_len": IntegerType(), "randomized": BooleanType(), "bits_in_frame": LongType(), "min_syncs": IntegerType(),
           "bit_ticks": DoubleType(), "period_ticks": LongType(), "rate_bps": DoubleType(), "use_rate_clock": BooleanType()}
_CONDITION = ["swap_bytes", "inverted"]
_PACKET = ["ord", "n_bits", "base_ticks"]
#: A packet's first and last ``HISTORY_BITS`` bits, each as two numbers of ``_HALF`` bits.
_EDGES, _HALF = ["head_0", "head_1", "tail_0", "tail_1"], kernels.HISTORY_BITS // 2
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_packets_stream(spark: SparkSession, path: str, schema, streams: DataFrame | None = None, on: list[str] | None = None,
                        pattern: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """A folder of packet files as a stream, routed to the streams configured on each channel by a static join."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    packets = (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)
    return packets if streams is None else route_packets(packets, streams, on)


class _Tracker:
    """One stream's state, advanced packet by packet. The rules are the batch operators'; totals are read at window ends alike."""

    def __init__(self, stream: str, saved: tuple | None) -> None:
        self.stream = stream
        (self.last_ord, self.bit_base, self.tail, self.anchor, self.count, self.locked, self.missed, self.frames, self.expected, self.seed,
         self.window, self.window_bits, self.base_locked, self.base_frames, self.silent) = saved or (-1, 0, "", -1, NO_LOCK, 0, 0, 0, 0, -1, 0, 0, 0, 0, -1)
        self.out: list[tuple] = []

    def saved(self) -> tuple:
        return (self.last_ord, self.bit_base, self.tail, self.anchor, self.count, self.locked, self.missed, self.frames, self.expected, self.seed,
                self.window, self.window_bits, self.base_locked, self.base_frames, self.silent)

    def totals_at(self, bit: int, cfg) -> tuple[int, int]:
        since = bit - self.anchor
        held = min(since, cfg.bits_in_frame) if self.count >= cfg.min_syncs else 0
        return self.locked + held, self.missed + max(0, (since - 1) // cfg.bits_in_frame)

    def window_of(self, base_ticks: int, cfg) -> int:
        """Window of a packet's first bit on its own clock."""
        seed = self.seed if self.seed >= 0 else max(0, base_ticks)
        return max(0, math.ceil(float(base_ticks - seed) / int(cfg.period_ticks)) - 1)

    def end_ms(self, cfg) -> int:
        """Event time, in whole milliseconds, at which the open window is over."""
        return -(-(self.seed + (self.window + 1) * int(cfg.period_ticks)) // 10_000)

    def fall_silent(self, watermark: int, cfg) -> None:
        """The open window is closed if the watermark has passed its end: all packets of it that are not late have been folded."""
        if self.window_bits and not cfg.use_rate_clock and self.end_ms(cfg) <= watermark:
            shown = len(self.out)
            self.close(self.bit_base - 1, cfg)
            self.out[shown] = (*self.out[shown][:6], SILENT, self.last_ord)
            self.silent = self.window - 1

    def close(self, last_bit: int, cfg) -> None:
        locked, missed = self.totals_at(last_bit, cfg)
        share = 100.0 * (locked - self.base_locked) / self.window_bits if self.window_bits else 0.0
        self.out.append((self.stream, self.window, (self.seed + self.window * cfg.period_ticks) / 1e7, share, missed + self.expected,
                         self.frames - self.base_frames, CLOSED, self.last_ord))
        self.base_locked, self.base_frames, self.window_bits = locked, self.frames, 0
        self.window += 1

    def show_open(self, cfg) -> None:
        """The window that is filling, as it stands; the state stays as it is."""
        if self.window_bits:
            state, shown = self.saved(), len(self.out)
            self.close(self.bit_base - 1, cfg)
            self.out[shown] = (*self.out[shown][:6], OPEN, self.last_ord)
            (self.last_ord, self.bit_base, self.tail, self.anchor, self.count, self.locked, self.missed, self.frames, self.expected, self.seed,
             self.window, self.window_bits, self.base_locked, self.base_frames, self.silent) = state

    def late(self, order: int, base_ticks: int, cfg) -> None:
        self.out.append((self.stream, self.window_of(base_ticks, cfg), None, None, None, None, LATE, order))

    def piece(self, cfg, rows: np.ndarray, head: str, tail: str, inside: np.ndarray) -> None:
        """Packets (``ord, n_bits, base_ticks``) in order, with the piece's first and last bits and its hits behind the first ones."""
        early = kernels.from_text(head)
        plain = kernels.with_history(np.packbits(early), early.size, self.tail, cfg.randomized)
        hits = np.concatenate([kernels.find_pattern(plain, early.size, cfg.pattern, cfg.mask), inside]) + self.bit_base
        hits = hits[hits >= cfg.sync_len - 1]
        cuts = np.searchsorted(hits, self.bit_base + np.cumsum(rows[:, 1]))
        at = 0
        for (order, n, base_ticks), upto in zip(rows.tolist(), cuts.tolist(), strict=True):
            self.packet(cfg, n, base_ticks, hits[at:upto])
            self.last_ord, at = order, upto
        self.tail = (self.tail + tail)[-kernels.HISTORY_BITS:]

    def packet(self, cfg, n: int, base_ticks: int, hits: np.ndarray) -> None:
        """One packet of ``n`` bits with the places of its hits."""
        period = int(cfg.period_ticks)
        if self.seed < 0:
            self.seed = 0 if cfg.use_rate_clock else max(0, base_ticks)
        rel = self.bit_base * cfg.bit_ticks if cfg.use_rate_clock else float(base_ticks - self.seed)
        first = max(0, math.ceil(rel / period) - 1)
        drops = []
        if self.bit_base and first > self.window:
            if self.silent < self.window - 1 or self.window_bits:  # else silence has closed the last window that had bits
                self.close(self.bit_base - 1, cfg)
            rate = cfg.rate_bps if cfg.rate_bps > 0 else (1e7 / cfg.bit_ticks if cfg.bit_ticks > 0 else 0.0)
            if first > self.window and rate > 0:
                drops = [self.bit_base]
            while self.window < first:
                self.expected += int(period / 1e7 * rate / cfg.bits_in_frame) if rate > 0 else 0
                self.close(self.bit_base - 1, cfg)
        rows, _, _ = fold_hits(hits, np.asarray(drops, np.int64), int(cfg.bits_in_frame), int(cfg.min_syncs), self.anchor, self.count)
        at, done = 0, 0
        while done < n:
            until = math.floor(((self.window + 1) * period - rel) / cfg.bit_ticks) + 1 if cfg.bit_ticks > 0 else n
            upto = min(n, max(done, until))
            if upto == done and done < n:
                self.close(self.bit_base + done - 1, cfg)
                continue
            last = self.bit_base + upto - 1
            while at < len(rows) and rows[at][1] <= last:
                kind, _, anchor, _, count, locked, lost, frame, _ = rows[at]
                self.locked, self.count = self.locked + locked, count
                if kind == ANCHOR:
                    self.anchor, self.missed, self.frames = anchor, self.missed + lost, self.frames + frame
                at += 1
            self.window_bits += upto - done
            done = upto
        self.bit_base += n


def _halves(bits: str) -> tuple[int, int]:
    """At most 80 bits as two numbers."""
    return int(bits[:_HALF] or "0", 2), int(bits[_HALF:] or "0", 2)


def _bits(first: int, second: int, n_bits: int) -> str:
    n = min(n_bits, kernels.HISTORY_BITS)
    return format(first, f"0{min(n, _HALF)}b") + (format(second, f"0{n - _HALF}b") if n > _HALF else "")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A packet's hits that lie behind its first ``HISTORY_BITS`` bits, and its edges; the payload goes no further. A last row per batch
    has no packet, only the newest time of the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        hits, edges = [], []
        for payload, n, *how in zip(*(column[c].to_pylist() for c in ("payload", "n_bits", "swap_bytes", "inverted", "randomized", "pattern", "mask")), strict=True):
            swap, invert, randomized, pattern, mask = how
            packed, _ = kernels.concat_bits([kernels.condition(payload, swap, invert)], [n])
            found = kernels.find_pattern(kernels.with_history(packed, n, "", randomized), n, pattern, mask)
            hits.append(found[found >= kernels.HISTORY_BITS].astype("<i8").tobytes())
            edges.append((*_halves(kernels.head_bits(packed, n)), *_halves(kernels.tail_bits(packed, n))))
        made = dict(zip(_EDGES, np.array(edges, np.int64).reshape(-1, len(_EDGES)).T, strict=True))
        names = ["stream_id", "chunk", *_PACKET, *_CONFIG]
        n = batch.num_rows
        arrays = [*(column[c] for c in names), *(pa.array(np.ascontiguousarray(x)) for x in made.values()), pa.array(hits, pa.binary()), pa.nulls(n, pa.timestamp("us", "UTC"))]
        names = [*names, *_EDGES, "hits", "clock"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)
        newest = max(column["base_ticks"].to_pylist()) // 10
        last = {"stream_id": pa.array([""]), "chunk": pa.array([-1], pa.int64()), "clock": pa.array([newest], pa.timestamp("us", "UTC"))}
        yield pa.RecordBatch.from_arrays([last.get(c, pa.nulls(1, a.type)) for c, a in zip(names, arrays, strict=True)], names=names)


_SLIM = StructType([StructField("stream_id", StringType()), StructField("chunk", LongType()), *[StructField(c, LongType()) for c in _PACKET],
                    *[StructField(c, t) for c, t in _CONFIG.items()], *[StructField(c, LongType()) for c in _EDGES], StructField("hits", BinaryType()),
                    StructField("clock", TimestampType())])
#: One piece: packets and hits packed as little-endian 64-bit numbers; ``as_of`` is behind the watermark it was given out at.
_PIECES = StructType([StructField("stream_id", StringType()), StructField("kind", StringType()), StructField("first", LongType()), StructField("packets", BinaryType()),
                      StructField("head", StringType()), StructField("tail", StringType()), StructField("hits", BinaryType()),
                      *[StructField(c, t) for c, t in _CONFIG.items()], StructField("as_of", TimestampType())])


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


class _Assemble(StatefulProcessor):
    """Packets of one chunk, held until the watermark has passed them, then given out in order as one piece."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ord long, n_bits long, base_ticks long, head_0 long, head_1 long, tail_0 long, tail_1 long, hits binary")
        self.upto = handle.getValueState("upto", "ord long")
        self.config = handle.getValueState("config", StructType([StructField(c, t) for c, t in _CONFIG.items()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == "":  # clock rows
            for _ in rows:
                pass
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        upto = self.upto.get()[0] if self.upto.exists() else -1
        late = []
        for frame in rows:
            if not self.config.exists() and len(frame):
                self.config.update(tuple(frame[c].iloc[0].item() if hasattr(frame[c].iloc[0], "item") else frame[c].iloc[0] for c in _CONFIG))
            new = list(zip(*(frame[c].tolist() for c in (*_PACKET, *_EDGES, "hits")), strict=True))
            late += [r[:3] for r in new if r[0] <= upto]
            new = [r for r in new if r[0] > upto]
            if new:
                self.held.appendList(new)
        if late:
            yield self._row(key[0], LATE, np.array(late, np.int64), "", "", b"", watermark)
        yield from self._due(key, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def _row(self, stream: str, kind: str, packets: np.ndarray, head: str, tail: str, hits: bytes, watermark: int) -> pd.DataFrame:
        return pd.DataFrame([(stream, kind, int(packets[0, 0]), packets.astype("<i8").tobytes(), head, tail, hits, *self.config.get(),
                              pd.Timestamp(watermark + 1, unit="ms"))], columns=_PIECES.fieldNames())

    def _due(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        held = sorted(self.held.get()) if self.held.exists() else []
        due = times = 0
        unique = {}
        for r in held:  # in order: a packet waits for one before it with a newer time
            times = max(times, -(-r[2] // 10_000))
            if times > watermark:
                break
            due += 1
            unique.setdefault(r[0], r)
        if due:
            twice = [r[:3] for r, before in zip(held[1:due], held[:due - 1], strict=True) if r[0] == before[0]]
            rest = held[due:]
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
            self.upto.update((held[due - 1][0],))
            yield self._joined(key[0], list(unique.values()), watermark)
            if twice:  # a packet that came twice before its turn
                yield self._row(key[0], LATE, np.array(twice, np.int64), "", "", b"", watermark)
        if due < len(held):
            self.handle.registerTimer(times)

    def _joined(self, stream: str, packets: list, watermark: int) -> pd.DataFrame:
        cfg = dict(zip(_CONFIG, self.config.get(), strict=True))
        head = tail = ""
        base, hits = 0, []
        for _, n, _, *edges, found in packets:
            first, last = _bits(*edges[:2], n), _bits(*edges[2:], n)
            start = kernels.from_text(first)
            plain = kernels.with_history(np.packbits(start), start.size, tail, cfg["randomized"])
            places = np.concatenate([kernels.find_pattern(plain, start.size, cfg["pattern"], cfg["mask"]), _numbers(found)]) + base
            hits.append(places[places >= kernels.HISTORY_BITS])  # the others depend on what is before the piece
            head = (head + first)[:kernels.HISTORY_BITS]
            tail = (tail + last)[-kernels.HISTORY_BITS:]
            base += n
        return self._row(stream, PIECE, np.array([p[:3] for p in packets], np.int64), head, tail, np.concatenate(hits).astype("<i8").tobytes(), watermark)

    def close(self) -> None:
        pass


class _Compose(StatefulProcessor):
    """Pieces of one stream, folded in order, one at a time."""

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", _STATE)
        self.config = handle.getValueState("config", StructType([StructField(c, t) for c, t in _CONFIG.items()]))
        self.pending = handle.getMapState("pending", "first long", "packets binary, head string, tail string, hits binary")

    def _tracker(self, stream: str) -> _Tracker:
        return _Tracker(stream, tuple(self.now.get()) if self.now.exists() else None)

    def _settings(self):
        return pd.DataFrame([tuple(self.config.get())], columns=list(_CONFIG)).itertuples(index=False).__next__()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late = []
        for frame in rows:
            for row in frame.itertuples(index=False):
                if not self.config.exists():
                    self.config.update(tuple(getattr(row, c) for c in _CONFIG))
                if row.kind == LATE:
                    late.append(_numbers(row.packets).reshape(-1, 3))
                else:
                    self.pending.updateValue((row.first,), (row.packets, row.head, row.tail, row.hits))
        tracker, cfg = self._tracker(key[0]), self._settings()
        for first in sorted(k[0] for k in self.pending.keys()):
            packets, head, tail, hits = self.pending.getValue((first,))
            self.pending.removeKey((first,))
            rows_of = _numbers(packets).reshape(-1, 3)
            if first > tracker.last_ord:
                tracker.piece(cfg, rows_of, head, tail, _numbers(hits))
            else:  # a chunk whose place was passed before any of it came
                late.append(rows_of)
            if len(tracker.out) > 4096:
                yield _frame(tracker)
        for some in late:
            for order, _, base_ticks in some.tolist():
                tracker.late(order, base_ticks, cfg)
        yield from self._done(tracker, cfg, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            yield from self._done(self._tracker(key[0]), self._settings(), timerValues.getCurrentWatermarkInMs(), shows=False)

    def _done(self, tracker: _Tracker, cfg, watermark: int, shows: bool = True) -> Iterator[pd.DataFrame]:
        tracker.fall_silent(watermark, cfg)
        if shows:
            tracker.show_open(cfg)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if tracker.window_bits and not cfg.use_rate_clock:
            self.handle.registerTimer(tracker.end_ms(cfg))
        self.now.update(tracker.saved())
        yield _frame(tracker)

    def close(self) -> None:
        pass


def _frame(tracker: _Tracker) -> pd.DataFrame:
    columns = {part.split()[0]: part.split()[1] for part in OUTPUT.split(", ")}
    out = pd.DataFrame(tracker.out, columns=list(columns))
    tracker.out = []
    return out.astype({c: "Int64" for c, kind in columns.items() if kind == "long"} | {"t_abs": float, "lock_pct": float})


def lock_tracker(packets: DataFrame, streams: DataFrame, delay: str = "10 seconds", ticks: DataFrame | None = None) -> DataFrame:
    """Closed, silent, open and late rows of every stream, as the module says, from packets with ``chunk``.

    ``delay`` is how far behind the newest time a packet may come and still be placed; ``ticks`` is a stream of ``clock`` timestamps that move
    the watermark as packets do. State lies in RocksDB.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    whole = packets.select("stream_id", *[F.col(c).cast("long").alias(c) for c in ("chunk", *_PACKET)], "payload").where("n_bits > 0").join(
        per_stream(streams.select("stream_id", *[F.col(c).cast(t).alias(c) for c, t in _CONFIG.items()], *_CONDITION)), "stream_id")
    slim = whole.mapInArrow(_scan, _SLIM)
    if ticks is not None:
        slim = slim.unionByName(ticks.select(F.lit("").alias("stream_id"), F.lit(-1).cast("long").alias("chunk"), F.col("clock").cast("timestamp").alias("clock")),
                                allowMissingColumns=True)
    # no nulls but in the clock: pandas would turn whole numbers beside them into floats
    filled = [F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name) if f.dataType in (LongType(), IntegerType(), DoubleType(), BooleanType())
              else F.col(f.name) for f in _SLIM.fields]
    pieces = slim.select(*filled).withWatermark("clock", delay).groupBy("stream_id", "chunk").transformWithStateInPandas(
        _Assemble(), _PIECES, "append", "EventTime", eventTimeColumnName="as_of")
    return pieces.groupBy("stream_id").transformWithStateInPandas(_Compose(), OUTPUT, "append", "EventTime")


def latest_samples(rows: DataFrame) -> DataFrame:
    """One sample per stream and window: the closed one (by a packet or by silence), else the newest open one. A stream's last window counts
    only if a frame ended in it by then."""
    newest = F.max_by(F.struct("t_abs", "lock_pct", "missed", "n_frames"), F.struct((F.col("kind") != OPEN).alias("c"), "ord"))
    seen = rows.where(F.col("kind") != LATE)
    last = seen.groupBy("stream_id").agg(F.max("window_idx").alias("_last"))
    samples = seen.groupBy("stream_id", "window_idx").agg(newest.alias("s")).join(last, "stream_id")
    return samples.where("window_idx < _last or s.n_frames > 0").select("stream_id", "window_idx", "s.*")


def late_packets(rows: DataFrame) -> DataFrame:
    """``stream_id, window_idx, ord`` of every packet that came after its place was given out, once for each time it came."""
    return rows.where(F.col("kind") == LATE).select("stream_id", "window_idx", "ord")


def late_counts(rows: DataFrame) -> DataFrame:
    """Late packets per stream and window."""
    return late_packets(rows).groupBy("stream_id", "window_idx").agg(F.count(F.lit(1)).alias("late"))


#: Time packets of one source and trigger that are held in memory, and the bytes of file whose packets make one value of state beyond that.
_HELD_TIMES, _TIME_SPAN = 1 << 16, 1 << 20


class _GapAlerts(StatefulProcessor):
    """Time packets of one source, compared in the order of their places in the file. Those of a trigger are put in order in memory, or, if they
    are many, by spans of the file in a map state: a call of state takes longer than a thousand comparisons."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "file_offset long, abs_ticks long")
        self.pending = handle.getMapState("pending", "span long", "times binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        upto, last = self.last.get() if self.last.exists() else (-1, -1)
        before, held, n, spans = upto, [], 0, set()
        for frame in rows:
            held.append(np.column_stack([frame["file_offset"].to_numpy(np.int64), frame["abs_ticks"].to_numpy(np.int64)]))
            n += len(frame)
            if n >= _HELD_TIMES:
                spans |= self._put(np.concatenate(held))
                held, n = [], 0
        if spans and held:
            spans |= self._put(np.concatenate(held))
        for times in (self._taken(s) for s in sorted(spans)) if spans else [np.concatenate(held)] if held else []:
            times = times[np.argsort(times[:, 0], kind="stable")]
            late = (times[:, 0] <= before) | np.r_[False, times[1:, 0] == times[:-1, 0]]  # reported without a gap
            offset, ticks = times[~late].T
            past = np.r_[last, ticks[:-1]]
            gap = (past[: ticks.size] >= 0) & (ticks - past[: ticks.size] > GAP_TICKS)
            if gap.any() or late.any():
                gone = times[late, 0]
                yield pd.DataFrame({"source_id": key[0], "file_offset": np.r_[gone, offset[gap]],
                                    "gap_s": np.r_[np.full(gone.size, np.nan), (ticks - past[: ticks.size])[gap] / 1e7]}).astype({"gap_s": "Float64"})
            if ticks.size:
                upto, last = int(offset[-1]), int(ticks[-1])
        self.last.update((upto, last))

    def _put(self, times: np.ndarray) -> set[int]:
        span = times[:, 0] // _TIME_SPAN
        order = np.argsort(span, kind="stable")
        span, times = span[order], times[order]
        cuts = np.flatnonzero(np.r_[True, span[1:] != span[:-1], True])
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = (int(span[a]),)
            there = self.pending.getValue(at)[0] if self.pending.containsKey(at) else b""
            self.pending.updateValue(at, (bytes(there) + times[a:b].astype("<i8").tobytes(),))
        return {int(s) for s in span[cuts[:-1]]}

    def _taken(self, span: int) -> np.ndarray:
        times = _numbers(self.pending.getValue((span,))[0]).reshape(-1, 2)
        self.pending.removeKey((span,))
        return times

    def close(self) -> None:
        pass


def time_gap_alerts(times: DataFrame) -> DataFrame:
    """One row for every gap between neighbouring time packets, as it is seen; a packet that came late has a row without ``gap_s``."""
    times.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return times.select("source_id", "file_offset", "abs_ticks").groupBy("source_id").transformWithStateInPandas(
        _GapAlerts(), "source_id int, file_offset long, gap_s double", "append", "None")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything a stream has now, written to ``path`` and read back."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
