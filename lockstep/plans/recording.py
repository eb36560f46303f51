"""A recording end to end: packets in, lock and receiver samples out, for every stream at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.operators import frames as fr
from lockstep.operators import sync, windows
from lockstep.operators.bits import scan_packets
from lockstep.operators.calibrate import apply_calibration
from lockstep.operators.scans import per_stream
from lockstep.session import materialize


@dataclass(frozen=True)
class LockRun:
    """The tables of one lock run. Payloads have been read once; everything here is slim."""

    hits: DataFrame
    chunks: DataFrame
    placed: DataFrame
    windows: DataFrame
    gaps: DataFrame
    anchors: DataFrame
    samples: DataFrame


def run_lock(packets: DataFrame, streams: DataFrame) -> LockRun:
    """Search, lock and window every stream. ``streams`` as from ``config.prepare_streams``.

    What several branches need - hits, the packet index, anchors, the lock at each window's end - is written once on the way.
    """
    hits, chunks = scan_packets(packets, streams)
    placed = materialize(windows.place_packets(packets, streams))
    bits = windows.bit_windows(placed)
    gaps = windows.gap_windows(placed, streams)
    anchors = sync.lock_anchors(hits, streams, windows.gap_drops(placed, streams))
    state = materialize(windows.lock_state_at(bits, anchors, streams))
    samples = windows.lock_samples(state, gaps, placed, streams)
    return LockRun(hits, chunks, placed, bits, gaps, anchors, samples)


def lock_percent(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Lock percentage and accumulated missed frames per window and stream."""
    return run_lock(packets, streams).samples


def raw_channel_means(packets: DataFrame, streams: DataFrame, word_map: DataFrame, run: LockRun | None = None) -> DataFrame:
    """Mean raw count of every mapped word per window."""
    run = run or run_lock(packets, streams)
    frames = fr.extract_frames(run.anchors, run.windows)
    return fr.channel_window_mean(packets, frames, run.samples, run.chunks, streams, word_map)


def receiver_levels(packets: DataFrame, streams: DataFrame, word_map: DataFrame, run: LockRun | None = None) -> DataFrame:
    """Calibrated level of every receiver channel per window.

    ``word_map`` carries each parameter's calibration (``slope, offset`` and optionally ``points``). Raw counts are averaged
    first and calibrated once, since a piecewise curve does not commute with the mean; a window without frames reads 0.
    """
    means = raw_channel_means(packets, streams, word_map, run)
    curve = word_map.select("stream_id", "ord", *[c for c in ("slope", "offset", "points") if c in word_map.columns])
    value = apply_calibration(F.col("raw_mean"), F.col("slope"), F.col("offset"), F.col("points") if "points" in word_map.columns else None)
    return (means.join(per_stream(curve), ["stream_id", "ord"])
            .withColumn("value", F.when(F.col("n_frames") > 0, value).otherwise(0.0))
            .select("stream_id", "word", "name", "ord", "window_idx", "t_abs", "raw_mean", "value"))
