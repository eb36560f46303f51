"""Extracting calibration curves from recorded step sweeps, for all channels of all recordings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lockstep.operators import steps as st
from lockstep.operators.scans import per_stream
from lockstep.operators.series import union_sources
from lockstep.plans.recording import raw_channel_means
from lockstep.session import materialize

KEYS = ["stream_id", "ord", "name", "word"]


def extract_calibration(packets: DataFrame, streams: DataFrame, word_map: DataFrame, steps: list[float], clip_start_s: float = 0.0,
                        clip_end_s: float = 0.0) -> DataFrame:
    """One row per stream and parameter with its profile (``points``) or the reason there is none.

    The same lock, frames and word map as a normal run, on the data-rate clock, raw counts averaged over about ten frames. Streams
    are grouped by that period, of which there are a handful.
    """
    timed = streams.withColumns({"use_rate_clock": F.lit(True), "_period": st.extraction_period(F.col("bits_in_frame"), F.col("bit_ticks"))})
    timed = materialize(timed.withColumn("period_ticks", F.round(F.col("_period") * 1e7).cast("long")))
    means = materialize(raw_channel_means(packets, timed, word_map))
    series = means.select(*KEYS, F.col("window_idx").alias("idx"), F.col("raw_mean").alias("raw"))
    parts = []
    for row in timed.select("period_ticks").distinct().collect():
        mine = series.join(per_stream(timed.where(F.col("period_ticks") == row.period_ticks).select("stream_id")), "stream_id", "left_semi")
        period = row.period_ticks / 1e7
        clipped = st.clip(mine, KEYS, period, clip_start_s, clip_end_s)
        ignored = clipped.groupBy(*KEYS).agg(F.bool_or("clip_ignored").alias("clip_ignored"))
        parts.append(st.detect_steps(clipped, KEYS, period, steps).join(ignored, KEYS).withColumn("period_s", F.lit(period)))
    found = union_sources(parts)
    # A parameter whose stream gave no samples has no data.
    return word_map.select(*KEYS).join(found, KEYS, "left").withColumns({
        "outcome": F.coalesce("outcome", F.lit("no_data")), "valid": F.coalesce("valid", F.lit(False)), "samples": F.coalesce("samples", F.lit(0))})


def profiles(results: DataFrame) -> DataFrame:
    """The valid profiles by word, ready for ``attach_profiles``; the first parameter of a word wins."""
    first = W.partitionBy("stream_id", "word").orderBy("ord")
    return (results.where("valid").withColumn("_n", F.row_number().over(first)).where("_n = 1")
            .select("stream_id", "word", "valid", "points"))
