"""Time windows over packets: tumbling ``(start, end]`` windows (the first also owns its start), gaps, and per-window results.

All clocks are 100 ns ticks. Windows never come from one row per bit: a packet's bits are spread over windows by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.operators.scans import Carry, ordered_scan, per_stream

TICKS_PER_SECOND = 10_000_000
_GAP_STRIDE = 100_000
WINDOWS_PER_CHUNK = 1 << 20


def window_index(rel: Column, period: Column) -> Column:
    """Index of the ``(start, end]`` window holding a time ``rel`` after the seed; earlier times belong to window 0."""
    return F.greatest(F.lit(0), F.ceil(rel / period) - 1).cast("long")


def assign_windows(df: DataFrame, time: str, seed: Column, period: float | Column, keys: list[str], order: list[str],
                   chunk: Column | None = None) -> DataFrame:
    """Add ``window_idx`` to rows in arrival order. A time that runs backwards stays in the window already reached."""
    period = period if isinstance(period, Column) else F.lit(period)
    raw = df.withColumn("_w", window_index(F.col(time) - seed, period))
    return ordered_scan(raw, keys, order, [Carry("window_idx", F.col("_w"), "max")], chunk).drop("_w")


def packet_index(packets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Dense ``seq`` and running ``bit_base`` per stream, on slim rows. Packets without bits are dropped."""
    keys = keys or ["stream_id"]
    extra = [c for c in packets.columns if c not in ("payload", *keys)]
    slim = packets.where("n_bits > 0").select(*keys, *extra)
    return ordered_scan(slim, keys, ["ord"], [Carry("seq", F.col("ord"), "count", inclusive=False),
                                              Carry("bit_base", F.col("n_bits"), "sum", inclusive=False)], F.col("chunk"))


def place_packets(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """``packet_index`` plus the window range of every packet on its stream's clock, and the empty windows right before it.

    The clock is the packets' own time from the first packet on, or bits at the data rate from zero. Adds ``rel`` (ticks after
    the seed), ``seed``, ``w_first``, ``w_last`` (never before a window already reached) and ``gap_from``, ``gap_windows``. A bit lasts
    no longer than a window, so a gap can only lie between packets. One row per packet, no payload.
    """
    slim = packets.where("n_bits > 0").select("stream_id", "ord", "chunk", "n_bits", "base_ticks")
    seeds = slim.groupBy("stream_id").agg(F.greatest(F.lit(0), F.min_by("base_ticks", "ord")).cast("long").alias("_seed"))
    config = streams.select("stream_id", "bit_ticks", "period_ticks", "use_rate_clock")
    rate, period = F.col("use_rate_clock"), F.col("period_ticks")
    own = (F.col("base_ticks") - F.col("_seed")).cast("double")
    timed = slim.join(per_stream(seeds), "stream_id").join(per_stream(config), "stream_id").withColumn(
        "_last", F.when(~rate, window_index(own + (F.col("n_bits") - 1) * F.col("bit_ticks"), period)))
    scanned = ordered_scan(timed, ["stream_id"], ["ord"], [
        Carry("seq", F.col("ord"), "count", inclusive=False), Carry("bit_base", F.col("n_bits"), "sum", inclusive=False),
        Carry("_max", F.col("_last"), "max", inclusive=False)], F.col("chunk"))
    # The rate clock never runs back: the window reached is that of the bit before.
    before = F.when(F.col("bit_base") > 0, window_index((F.col("bit_base") - 1) * F.col("bit_ticks"), period))
    rel = F.when(rate, F.col("bit_base") * F.col("bit_ticks")).otherwise(own)
    placed = scanned.select("*", rel.alias("rel"), F.when(rate, F.lit(0)).otherwise(F.col("_seed")).cast("long").alias("seed"),
                            F.when(rate, before).otherwise(F.col("_max")).alias("_reached"))
    start = window_index(F.col("rel"), period)
    end = window_index(F.col("rel") + (F.col("n_bits") - 1) * F.col("bit_ticks"), period)
    reached = F.coalesce("_reached", F.lit(0))
    return placed.select(
        "stream_id", "ord", "chunk", "n_bits", "seq", "bit_base", "rel", "seed", "bit_ticks", "period_ticks",
        F.greatest(start, reached).alias("w_first"), F.greatest(end, reached).alias("w_last"),
        (F.col("_reached") + 1).alias("gap_from"),
        F.greatest(F.lit(0), F.coalesce(start - F.col("_reached") - 1, F.lit(0))).alias("gap_windows"))


def packet_windows(placed: DataFrame) -> DataFrame:
    """The bits of every packet per window: ``bit_from``, ``bit_to`` (inclusive) and ``bits``."""
    spread = placed.withColumn("window_idx", F.explode(F.sequence("w_first", "w_last")))

    def bits_up_to(window: Column) -> Column:
        until = (window + 1) * F.col("period_ticks") - F.col("rel")
        inside = F.floor(F.try_divide(until, F.col("bit_ticks"))) + 1
        return F.least(F.col("n_bits"), F.greatest(F.lit(0), inside)).cast("long")

    high = F.when(F.col("window_idx") == F.col("w_last"), F.col("n_bits")).otherwise(bits_up_to(F.col("window_idx")))
    low = F.when(F.col("window_idx") == F.col("w_first"), F.lit(0)).otherwise(bits_up_to(F.col("window_idx") - 1))
    return (spread.withColumns({"_high": high, "_low": low}).where("_high > _low")
            .select("stream_id", "ord", "chunk", "window_idx", (F.col("bit_base") + F.col("_low")).alias("bit_from"),
                    (F.col("bit_base") + F.col("_high") - 1).alias("bit_to"), (F.col("_high") - F.col("_low")).alias("bits")))


def bit_windows(placed: DataFrame) -> DataFrame:
    """One row per window that holds bits: its bits, its range of stream bits, and the chunks of its first and last bit."""
    return packet_windows(placed).groupBy("stream_id", "window_idx").agg(
        F.sum("bits").alias("bits"), F.min("bit_from").alias("bit_from"), F.max("bit_to").alias("bit_to"),
        F.min_by("chunk", "bit_from").alias("chunk_from"), F.max_by("chunk", "bit_to").alias("chunk_to"))


def gap_drops(placed: DataFrame, streams: DataFrame) -> DataFrame:
    """Where a recording gap drops the lock: the first bit after at least one empty window (if the data rate is known)."""
    rate = streams.select("stream_id", data_rate().alias("_rate"))
    return (placed.where("gap_windows > 0").join(per_stream(rate), "stream_id").where("_rate > 0")
            .select("stream_id", "chunk", F.col("bit_base").alias("bit")))


def gap_windows(placed: DataFrame, streams: DataFrame) -> DataFrame:
    """One row per empty window of a gap with the frames expected in it, from the data rate."""
    expected = F.floor(F.col("period_ticks") / TICKS_PER_SECOND * data_rate() / F.col("bits_in_frame"))
    frames = streams.select("stream_id", F.when(data_rate() > 0, expected).otherwise(0).cast("long").alias("expected"))
    last = F.col("gap_from") + F.col("gap_windows") - 1
    strides = placed.where("gap_windows > 0").select(
        "stream_id", last.alias("_last"), F.explode(F.sequence("gap_from", last, F.lit(_GAP_STRIDE).cast("long"))).alias("_start"))
    stop = F.least("_last", F.col("_start") + _GAP_STRIDE - 1)
    return strides.select("stream_id", F.explode(F.sequence("_start", stop)).alias("window_idx")).join(per_stream(frames), "stream_id")


def data_rate() -> Column:
    """Bits per second: the configured rate, else one bit per bit period."""
    return F.when(F.col("rate_bps") > 0, F.col("rate_bps")).otherwise(F.coalesce(F.try_divide(F.lit(1.0e7), F.col("bit_ticks")), F.lit(0.0)))


def lock_state_at(windows: DataFrame, anchors: DataFrame, streams: DataFrame) -> DataFrame:
    """Locked bits, missed frames and extracted frames from the start of the stream to the last bit of each window."""
    events = anchors.select("stream_id", "chunk", "bit", F.col("kind").alias("_kind"), F.struct("anchor", "count").alias("_state"),
                            "locked", "missed", F.col("frame").cast("long").alias("_frame"))
    probes = windows.select("stream_id", F.col("chunk_to").alias("chunk"), F.col("bit_to").alias("bit"), F.lit(2).alias("_kind"),
                            "window_idx", "bits")
    scanned = ordered_scan(events.unionByName(probes, allowMissingColumns=True), ["stream_id"], ["bit", "_kind"],
                           [Carry("_at", F.col("_state"), "last"), Carry("_locked", F.col("locked"), "sum"),
                            Carry("_missed", F.col("missed"), "sum"), Carry("frames_so_far", F.col("_frame"), "sum")], F.col("chunk"))
    size = streams.select("stream_id", F.col("bits_in_frame").cast("long"), F.col("min_syncs").cast("int"))
    at = scanned.where("_kind = 2").join(per_stream(size), "stream_id").withColumn(
        "_since", F.col("bit") - F.coalesce("_at.anchor", F.lit(-1)))
    holding = F.when(F.coalesce("_at.count", F.lit(-1)) >= F.col("min_syncs"), F.least("_since", "bits_in_frame")).otherwise(0)
    return at.select("stream_id", "window_idx", "bits", (F.col("_locked") + holding).alias("locked_so_far"),
                     (F.col("_missed") + F.greatest(F.lit(0), F.expr("(_since - 1) div bits_in_frame"))).alias("missed_so_far"),
                     "frames_so_far")


def lock_samples(state: DataFrame, gaps: DataFrame, placed: DataFrame, streams: DataFrame) -> DataFrame:
    """One sample per window in time order, gaps filled in.

    ``lock_pct`` is locked bits over all bits of the window (0 in a gap); ``missed`` accumulates over the recording, counting
    the frames a gap must have held. The last window is kept only if a frame ended in it, and a stream without frames has none.
    """
    rows = state.unionByName(gaps, allowMissingColumns=True).na.fill(0, ["bits", "expected"])
    cut = F.expr(f"window_idx div {WINDOWS_PER_CHUNK}")
    scanned = ordered_scan(rows, ["stream_id"], ["window_idx"], [
        Carry("_locked_before", F.col("locked_so_far"), "max", inclusive=False),
        Carry("_frames_before", F.col("frames_so_far"), "max", inclusive=False),
        Carry("_missed", F.col("missed_so_far"), "max"), Carry("_expected", F.col("expected"), "sum")], cut)
    totals = state.groupBy("stream_id").agg(F.max("window_idx").alias("_last"), F.max("frames_so_far").alias("_frames"))
    seeds = placed.groupBy("stream_id").agg(F.first("seed").alias("seed"))
    period = streams.select("stream_id", "period_ticks")
    locked = F.col("locked_so_far") - F.coalesce("_locked_before", F.lit(0))
    frames = F.coalesce(F.col("frames_so_far") - F.coalesce("_frames_before", F.lit(0)), F.lit(0))
    return (scanned.join(per_stream(totals.where("_frames > 0")), "stream_id").join(per_stream(seeds), "stream_id").join(per_stream(period), "stream_id")
            .withColumn("n_frames", frames).where("window_idx < _last or n_frames > 0")
            .select("stream_id", "window_idx",
                    ((F.col("seed") + F.col("window_idx") * F.col("period_ticks")) / TICKS_PER_SECOND).alias("t_abs"),
                    F.when(F.col("bits") > 0, 100.0 * locked / F.col("bits")).otherwise(0.0).alias("lock_pct"),
                    (F.coalesce("_missed", F.lit(0)) + F.col("_expected")).cast("long").alias("missed"), "n_frames"))


# --- the same rules on any timed table ----------------------------------------------------------------------------------

def fill_windows(df: DataFrame, keys: list[str], window: str = "window_idx") -> DataFrame:
    """Every window from 0 to each key's last, those without rows included. ``filled`` marks the added ones.

    Missing windows come from the distance to the window before, so no key's windows are listed in one place.
    """
    have = df.select(*keys, window).distinct()
    cut = F.expr(f"{window} div {WINDOWS_PER_CHUNK}")
    gaps = (ordered_scan(have, keys, [window], [Carry("_prev", F.col(window), "last", inclusive=False)], cut)
            .withColumn("_prev", F.coalesce("_prev", F.lit(-1).cast("long"))).where(f"{window} > _prev + 1")
            .select(*keys, (F.col(window) - 1).alias("_last"),
                    F.explode(F.sequence(F.col("_prev") + 1, F.col(window) - 1, F.lit(_GAP_STRIDE).cast("long"))).alias("_start")))
    missing = gaps.select(*keys, F.explode(F.sequence("_start", F.least("_last", F.col("_start") + _GAP_STRIDE - 1))).alias(window))
    return (df.withColumn("filled", F.lit(False))
            .unionByName(missing.withColumn("filled", F.lit(True)), allowMissingColumns=True))


def window_share(df: DataFrame, keys: list[str], good: Column, window: str = "window_idx") -> DataFrame:
    """Percentage of a window's rows that are ``good``."""
    return df.groupBy(*keys, window).agg(F.count(F.lit(1)).alias("rows"),
                                         (100.0 * F.count_if(good) / F.count(F.lit(1))).alias("share_pct"))


def accumulate(df: DataFrame, keys: list[str], value: str, name: str, window: str = "window_idx") -> DataFrame:
    """Running total of ``value`` at each window's close."""
    cut = F.expr(f"{window} div {WINDOWS_PER_CHUNK}")
    return ordered_scan(df, keys, [window], [Carry(name, F.col(value), "sum")], cut)


def drop_empty_tail(df: DataFrame, keys: list[str], weight: str, window: str = "window_idx") -> DataFrame:
    """Without each key's last window when its ``weight`` is zero."""
    last = df.groupBy(*keys).agg(F.max(window).alias("_last"))
    return df.join(last, keys).where((F.col(window) < F.col("_last")) | (F.col(weight) > 0)).drop("_last")


def window_mean(df: DataFrame, keys: list[str], value: str, window: str = "window_idx", name: str = "raw_mean") -> DataFrame:
    """Mean per window; a filled window (no value) is 0.0, not calibrated from nothing."""
    mean = df.groupBy(*keys, window).agg(F.count(value).alias("n"), F.avg(value).alias("_mean"))
    return mean.withColumn(name, F.coalesce("_mean", F.lit(0.0))).drop("_mean")
