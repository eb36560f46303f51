"""Finding calibration steps in a recorded sweep: from a raw series to (raw, dB) points, for all channels at once.

A series is ``keys, idx, raw`` with ``idx`` dense from 0. Plateaus are found from transitions alone - the few samples where the
series moves - so the long quiet stretches are never walked or sorted for every threshold tried.

Joins here carry the hint "merge": samples are often generated from a small table, Spark takes them to be as small as that table, and would
gather them on the driver to send them to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lockstep.functions.text import channel_part, receiver_number
from lockstep.operators.scans import Carry, exact_median, ordered_scan
from lockstep.session import materialize

# How steps are told from noise.
EDGE_SIGMAS = 6.0
MIN_EDGE_SIGMAS = 1.5
MIN_EDGE_COUNTS = 2.0
RELAX_FACTOR = 0.7
MAX_ATTEMPTS = 8
CONFIRM_SECONDS = 1.0
MIN_CONFIRM_SAMPLES = 3
SAME_LEVEL_FRACTION = 0.1
MAJOR_EDGE_FRACTION = 0.25
MAX_DWELL_ERROR = 0.25
RAIL_FRACTION = 0.98
FULL_SCALE = 65535.0
MIN_PARTIAL_STEPS = 3
MAX_LEAD_IN = 1
MAD_TO_SIGMA = 1.4826
FRAMES_PER_SAMPLE = 10
MIN_PERIOD_S, MAX_PERIOD_S = 0.1, 0.2

_SAMPLES_PER_CHUNK = 1 << 20


def extraction_period(bits_in_frame: Column, bit_ticks: Column) -> Column:
    """Sample period in seconds for an extraction: ten frames, within 0.1 .. 0.2 s."""
    wanted = FRAMES_PER_SAMPLE * bits_in_frame * bit_ticks / 1.0e7
    return F.when((bit_ticks > 0) & (bits_in_frame > 0), F.least(F.lit(MAX_PERIOD_S), F.greatest(F.lit(MIN_PERIOD_S), wanted))).otherwise(0.01)


def confirm_samples(period_s: float) -> int:
    return max(MIN_CONFIRM_SAMPLES, -int(-CONFIRM_SECONDS // period_s))


def clip(series: DataFrame, keys: list[str], period_s: float, start_s: float = 0.0, end_s: float = 0.0) -> DataFrame:
    """Without the first and last seconds (whole samples), renumbered. A clip that would leave nothing is ignored and flagged."""
    lead, tail = int(max(0.0, start_s) / period_s), int(max(0.0, end_s) / period_s)
    size = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    keeps = F.least(F.lit(lead), "_n") < F.col("_n") - F.least(F.lit(tail), "_n")
    ranged = series.join(size.hint("merge"), keys).withColumns({"_keeps": keeps, "clip_ignored": ~keeps})
    return (ranged.where(~F.col("_keeps") | ((F.col("idx") >= lead) & (F.col("idx") < F.col("_n") - tail)))
            .withColumn("idx", F.when(F.col("_keeps"), F.col("idx") - lead).otherwise(F.col("idx"))).drop("_n", "_keeps"))


def derivative(series: DataFrame, keys: list[str]) -> DataFrame:
    """``d`` at ``idx`` is the change from sample ``idx`` to the next; the last sample has none."""
    cut = F.expr(f"idx div {_SAMPLES_PER_CHUNK}")
    after = ordered_scan(series.hint("merge"), keys, ["idx"], [Carry("next_raw", F.col("raw"), "next", inclusive=False)], cut)
    return after.where("next_raw is not null").withColumn("d", F.col("next_raw") - F.col("raw"))


def live_sigma(deriv: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Robust spread of the changes, leaving out samples resting exactly on the series' minimum or maximum (all, if all do)."""
    ends = series.groupBy(*keys).agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    pinned = (F.col("raw") == F.col("next_raw")) & F.col("raw").isin(F.col("_lo"), F.col("_hi"))
    marked = deriv.join(ends.hint("merge"), keys).select(*keys, "d", pinned.alias("pinned"))
    counts = marked.groupBy(*keys, "d", "pinned").agg(F.count(F.lit(1)).alias("n"))  # from here on a row is a change, however often it is seen
    alive = counts.withColumn("_alive", F.bool_or(~F.col("pinned")).over(W.partitionBy(*keys)))
    used = alive.where(~F.col("pinned") | ~F.col("_alive")).select(*keys, "d", "n")
    middle = exact_median(used, keys, "d", "_med", "n").hint("merge")
    centred = used.join(middle, keys).withColumn("dev", F.abs(F.col("d") - F.col("_med")))
    return exact_median(centred, keys, "dev", "_mad", "n").select(*keys, (MAD_TO_SIGMA * F.col("_mad")).alias("sigma"))


def mark_stable(series: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Flag each sample: it is unstable if the change into it or out of it exceeds the threshold."""
    cut = F.expr(f"idx div {_SAMPLES_PER_CHUNK}")
    near = ordered_scan(series.hint("merge"), keys, ["idx"], [Carry("_prev", F.col("raw"), "last", inclusive=False),
                                                Carry("_next", F.col("raw"), "next", inclusive=False)], cut)
    moved = F.coalesce(F.abs(F.col("raw") - F.col("_prev")) > threshold, F.lit(False)) | F.coalesce(
        F.abs(F.col("_next") - F.col("raw")) > threshold, F.lit(False))
    return near.withColumn("stable", ~moved).drop("_prev", "_next")


def plateaus(edges: DataFrame, sizes: DataFrame, keys: list[str], confirm: int) -> DataFrame:
    """Stable runs of at least ``confirm`` samples, as ``[begin, end)``.

    ``edges`` are the changes beyond the threshold (``idx``; samples idx and idx + 1 are unstable), ``sizes`` the samples per key
    (``n``). A plateau is what lies between two neighbouring edges.
    """
    ends = sizes.select(*keys, F.explode(F.array(F.lit(-2).cast("long"), F.col("n").cast("long"))).alias("idx"))
    marks = edges.select(*keys, F.col("idx").cast("long").alias("idx")).unionByName(ends)
    cut = F.expr(f"(idx + 2) div {_SAMPLES_PER_CHUNK}")
    spaced = ordered_scan(marks.hint("merge"), keys, ["idx"], [Carry("_prev", F.col("idx"), "last", inclusive=False)], cut)
    return spaced.select(*keys, (F.col("_prev") + 2).alias("begin"), F.col("idx").alias("end")).where(F.col("end") - F.col("begin") >= confirm)


def plateau_levels(found: DataFrame, series: DataFrame, keys: list[str], confirm: int, series_keys: list[str] | None = None) -> DataFrame:
    """Each plateau's settled ``value``: the mean of its last ``confirm`` samples."""
    series_keys = series_keys or keys
    tail = found.withColumn("idx", F.explode(F.sequence(F.greatest("begin", F.col("end") - confirm), F.col("end") - 1)))
    values = series.select(*series_keys, F.col("idx").cast("long").alias("idx"), "raw")
    return tail.join(values.hint("merge"), [*series_keys, "idx"]).groupBy(*keys, "begin", "end").agg(F.avg("raw").alias("value"))


def coalesce_levels(levels: DataFrame, keys: list[str], tolerance: Column) -> DataFrame:
    """Merge neighbouring levels within the tolerance; the later value stands for both."""
    order = W.partitionBy(*keys).orderBy("begin")
    apart = levels.withColumn("_apart", F.coalesce((F.abs(F.col("value") - F.lag("value").over(order)) > tolerance), F.lit(True)).cast("int"))
    grouped = apart.withColumn("_g", F.sum("_apart").over(order))
    kept = [c for c in levels.columns if c not in (*keys, "begin", "end", "value")]
    return grouped.groupBy(*keys, "_g").agg(F.max_by("value", "begin").alias("value"), F.min("begin").alias("begin"),
                                            F.max("end").alias("end"), *[F.first(c).alias(c) for c in kept]).drop("_g")


def median_gap(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Median size of the change between neighbouring levels (0 for fewer than two)."""
    order = W.partitionBy(*keys).orderBy("begin")
    gaps = levels.select(*keys, F.abs(F.col("value") - F.lag("value").over(order)).alias("gap"))
    return (levels.select(*keys).distinct().join(exact_median(gaps, keys, "gap", "median_gap").hint("merge"), keys, "left")
            .withColumn("median_gap", F.coalesce("median_gap", F.lit(0.0))))


def monotonic_runs(levels: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """Maximal runs whose every change exceeds the threshold in one direction; neighbouring runs share an end.

    Returns ``run_begin, run_end`` (level numbers from 0), ``direction`` and ``levels``.
    """
    order = W.partitionBy(*keys).orderBy("begin")
    step = F.col("value") - F.lag("value").over(order)
    turned = levels.select(*keys, "begin", (F.row_number().over(order) - 1).alias("level_no"),
                           F.when(step > threshold, 1).when(step < -threshold, -1).otherwise(0).alias("direction"))
    fresh = (F.col("direction") != F.coalesce(F.lag("direction").over(order), F.lit(0))).cast("int")
    runs = turned.withColumn("_fresh", fresh).withColumn("_g", F.sum("_fresh").over(order))
    return (runs.where("direction <> 0").groupBy(*keys, "_g").agg(
        (F.min("level_no") - 1).alias("run_begin"), F.max("level_no").alias("run_end"), F.first("direction").alias("direction"))
        .drop("_g").withColumn("levels", F.col("run_end") - F.col("run_begin") + 1))


def select_sweep(runs: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """The first run with at least ``expected`` levels, and where its last ``expected`` levels start."""
    first = runs.where(F.col("levels") >= expected).groupBy(*keys).agg(
        F.min_by(F.struct("run_end", "levels"), "run_begin").alias("r"))
    return first.select(*keys, (F.col("r.run_end") - expected + 1).alias("sweep_start"), F.col("r.levels").alias("sweep_levels"))


def thresholds(sigma: DataFrame, keys: list[str]) -> DataFrame:
    """The edge thresholds to try per key, largest first: nominal, then relaxed down to the noise floor."""
    nominal = F.greatest(EDGE_SIGMAS * F.col("sigma"), F.lit(MIN_EDGE_COUNTS))
    floor = F.greatest(MIN_EDGE_SIGMAS * F.col("sigma"), F.lit(MIN_EDGE_COUNTS))
    tries = F.array(*[F.struct(F.lit(k).alias("attempt"), F.pow(F.lit(RELAX_FACTOR), F.lit(k)).alias("scale")) for k in range(MAX_ATTEMPTS)])
    made = F.filter(tries, lambda t: (t.attempt == 0) | (F.col("nominal") * t.scale >= F.col("_floor")))
    return (sigma.withColumn("nominal", nominal).withColumn("_floor", floor).withColumn("t", F.explode(made))
            .withColumn("threshold", F.col("nominal") * F.col("t.scale"))
            .select(*keys, "sigma", "nominal", F.col("t.attempt").alias("attempt"), "threshold"))


def attempt_levels(series: DataFrame, deriv: DataFrame, tries: DataFrame, keys: list[str], confirm: int) -> tuple[DataFrame, DataFrame]:
    """Plateaus and merged levels for every (key, attempt)."""
    both = [*keys, "attempt"]
    tries = tries.select(*both, "threshold").hint("merge")
    edges = deriv.select(*keys, "idx", F.abs("d").alias("_size")).join(tries, keys).where("_size > threshold")
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").join(tries.drop("threshold"), keys)
    found = materialize(plateaus(edges, sizes, both, confirm))
    levels = plateau_levels(found, series, both, confirm, keys).join(tries, both)
    once = materialize(coalesce_levels(levels, both, F.col("threshold")))
    gap = median_gap(once, both).hint("merge")
    twice = coalesce_levels(once.join(gap, both), both, F.greatest("threshold", SAME_LEVEL_FRACTION * F.col("median_gap")))
    return found, twice.select(*both, "threshold", "begin", "end", "value")


_POINT = "struct<raw_avg:double,true_db:double>"


def detect_steps(series: DataFrame, keys: list[str], period_s: float, steps: list[float]) -> DataFrame:
    """One row per key: the calibration points a sweep gives, or why it gives none.

    ``outcome`` is no_data, flat, too_few_plateaus, no_monotonic_sweep or calibrated. Thresholds are relaxed until a clean sweep of
    ``len(steps)`` levels appears; failing that, a sweep that ran onto the converter's rail is calibrated as far as it got.
    """
    confirm, expected = confirm_samples(period_s), len(steps)
    series = series.select(*keys, F.col("idx").cast("long").alias("idx"), F.col("raw").cast("double").alias("raw"))
    # dealt anew: the tasks that read a small table each generate a large part of the samples
    series = materialize(series.repartition(*keys, F.expr(f"idx div {_SAMPLES_PER_CHUNK}")))
    everyone = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    deriv = materialize(derivative(series, keys))
    tries = materialize(thresholds(live_sigma(deriv, series, keys), keys))
    found, levels = attempt_levels(series, deriv, tries, keys, confirm)
    levels = materialize(levels)
    both = [*keys, "attempt"]
    runs = materialize(monotonic_runs(levels, both, F.col("threshold")))
    counts = levels.groupBy(*both).agg(F.count(F.lit(1)).alias("n_levels"))
    swept = materialize(relax_threshold(select_sweep(runs, both, expected), keys)) if expected else None
    order = W.partitionBy(*both).orderBy("begin")
    numbered = materialize(levels.withColumn("level_no", F.row_number().over(order) - 1))
    seen = counts.groupBy(*keys).agg(F.max("n_levels").alias("best_levels"), F.bool_or(F.col("n_levels") >= expected).alias("reached"))
    nominal = (numbered.where("attempt = 0").groupBy(*keys)
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("level_no", "value"))), lambda s: s.value).alias("plateau_levels")))
    n_plateaus = found.groupBy(*both).agg(F.count(F.lit(1)).alias("n_plateaus"))
    parts = [tries.where("attempt = 0").select(*keys, "nominal"), seen, nominal,
             n_plateaus.where("attempt = 0").select(*keys, F.col("n_plateaus").alias("detected_plateaus"))]
    base = everyone
    for part in parts:
        base = base.join(part.hint("merge"), keys, "left")
    if not expected:
        swept = base.select(*keys, F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("int").alias("sweep_start"),
                            F.lit(None).cast("int").alias("sweep_levels")).where("false")
    swept = swept.hint("merge")
    points = pair_steps(numbered.join(swept, both), keys, steps).hint("merge")
    accepted = (swept.join(n_plateaus, both).join(tries.select(*both, "threshold").hint("merge"), both)
                .select(*keys, F.col("attempt").alias("accepted_attempt"), F.col("threshold").alias("accepted_threshold"), "sweep_levels",
                        (F.col("n_plateaus") > expected).alias("extra_plateaus")).join(points, keys))
    full = materialize(base.join(accepted.hint("merge"), keys, "left"))  # one row per key; what is below uses it five times
    failed = full.where("accepted_attempt is null").select(*keys)
    rails = saturated_top(failed, numbered.where("attempt = 0"), runs.where("attempt = 0"), deriv, series, keys, steps, confirm)
    out = full.join(rails.withColumnsRenamed({"points": "_points", "sweep_levels": "_levels"}).hint("merge"), keys, "left")
    good, railed = F.col("accepted_attempt").isNotNull(), F.col("_points").isNotNull()
    return out.select(
        *keys, "samples",
        classify_outcome(good | railed, F.col("samples"), F.coalesce("best_levels", F.lit(0)), F.coalesce("reached", F.lit(False))).alias("outcome"),
        (good | railed).alias("valid"), F.coalesce("detected_plateaus", F.lit(0)).alias("detected_plateaus"),
        F.coalesce("plateau_levels", F.array().cast("array<double>")).alias("plateau_levels"),
        F.coalesce("accepted_threshold", "nominal").alias("edge_threshold"),
        F.coalesce(F.col("accepted_attempt") > 0, F.lit(False)).alias("relaxed"), railed.alias("saturated"),
        F.coalesce("sweep_levels", "_levels", F.lit(0)).cast("int").alias("sweep_levels"),
        F.coalesce("extra_plateaus", F.lit(False)).alias("extra_plateaus"),
        F.coalesce("unresolved_db", F.array().cast("array<double>")).alias("unresolved_db"),
        F.coalesce("points", "_points", F.array().cast(f"array<{_POINT}>")).alias("points"))


def relax_threshold(sweeps: DataFrame, keys: list[str]) -> DataFrame:
    """Of the attempts that found a sweep, the most conservative (the first)."""
    first = sweeps.groupBy(*keys).agg(F.min_by(F.struct("attempt", "sweep_start", "sweep_levels"), "attempt").alias("s"))
    return first.select(*keys, "s.attempt", "s.sweep_start", "s.sweep_levels")


def pair_steps(levels: DataFrame, keys: list[str], steps: list[float]) -> DataFrame:
    """The nth level of the sweep is the nth step; points are sorted by raw count."""
    db = F.array(*[F.lit(float(s)) for s in steps]).cast("array<double>")
    at = F.col("level_no") - F.col("sweep_start")
    paired = levels.where((at >= 0) & (at < len(steps))).select(
        *keys, F.struct(F.col("value").alias("raw_avg"), at.alias("at"), F.try_element_at(db, (at + 1).cast("int")).alias("true_db")).alias("p"))
    return paired.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p.raw_avg, p.true_db)).alias("points"))


def classify_outcome(calibrated: Column, samples: Column, best_levels: Column, reached: Column) -> Column:
    """How far a channel got: one level only is flat; enough levels but no sweep is no_monotonic_sweep."""
    return (F.when(calibrated, "calibrated").when(samples < 2, "no_data").when(best_levels <= 1, "flat")
            .when(reached, "no_monotonic_sweep").otherwise("too_few_plateaus"))


# --- a sweep that ran onto the rail -----------------------------------------------------------------------------------

def is_railed(value: Column) -> Column:
    return (value >= RAIL_FRACTION * FULL_SCALE) | (value <= (1.0 - RAIL_FRACTION) * FULL_SCALE)


def saturated_top(candidates: DataFrame, levels: DataFrame, runs: DataFrame, deriv: DataFrame, series: DataFrame,
                  keys: list[str], steps: list[float], confirm: int) -> DataFrame:
    """Points of the steps below the rail (``points, unresolved_db, sweep_levels``), for keys where that can be told.

    The longest run must end on railed levels with enough measured ones before them. Which steps those are comes from timing:
    transitions must lie on a grid of equal dwells, and a level's step is its dwell counted from the run's first. A dwell the
    grid shows but no plateau confirmed is measured from its own settled samples.
    """
    expected, candidates = len(steps), candidates.hint("merge")
    mine = levels.join(candidates, keys, "left_semi")
    longest = (runs.join(candidates, keys, "left_semi").groupBy(*keys)
               .agg(F.max_by(F.struct("run_begin", "run_end"), F.struct("levels", -F.col("run_begin"))).alias("r"))
               .select(*keys, "r.run_begin", "r.run_end")).hint("merge")
    inside = materialize(mine.join(longest, keys).where("level_no between run_begin and run_end"))
    railed = inside.withColumn("_open", F.when(~is_railed(F.col("value")) | (F.col("level_no") == F.col("run_begin")), F.col("level_no")))
    summary = railed.groupBy(*keys, "run_begin", "run_end").agg(
        F.max("_open").alias("last"), F.array_sort(F.collect_list(F.struct("level_no", "value", "begin"))).alias("levels"))
    measured = F.col("last") - F.col("run_begin") + 1
    short = summary.where((F.col("last") < F.col("run_end")) & (measured >= max(MIN_PARTIAL_STEPS, expected // 2)))
    gap = median_gap(inside, keys).withColumn("major", MAJOR_EDGE_FRACTION * F.col("median_gap")).drop("median_gap")
    marked = materialize(short.join(gap.hint("merge"), keys)).hint("merge")
    edges = (deriv.select(*keys, "idx", "d").join(marked.select(*keys, "major"), keys).where(F.abs("d") >= F.col("major"))
             .groupBy(*keys).agg(F.array_sort(F.collect_list("idx")).alias("marks")))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema.fields if f.name in keys)
    # Nested array expressions are copied into each other by the optimizer and then evaluated once per element of each: one loop per key instead.
    ready = materialize(marked.join(edges, keys).select(*keys, "run_begin", "run_end", "last", "levels", "marks").mapInPandas(
        lambda frames: _place_levels(frames, keys, expected),
        f"{types}, bounds array<long>, slots array<int>, level_slots array<int>, values array<double>, sweep_levels int"))
    holes = (ready.select(*keys, "bounds", "slots", F.posexplode(F.slice("slots", 1, F.size("slots") - 1)).alias("i", "slot_at"))
             .where(F.expr("slots[i + 1] - slot_at = 1"))
             .select(*keys, (F.col("slot_at") + 1).alias("slot"), F.expr("greatest(bounds[i] + 2, bounds[i + 1] - " + str(confirm) + ")").alias("lo"),
                     F.expr("bounds[i + 1]").alias("hi")).where(F.col("hi") - F.col("lo") >= MIN_CONFIRM_SAMPLES))
    tails = holes.select(*keys, "slot", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("idx")).join(series.hint("merge"), [*keys, "idx"])
    dwell = exact_median(tails, [*keys, "slot"], "raw", "level").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("slot", "level"))).alias("holes"))
    rows = ready.join(dwell.hint("merge"), keys, "left").select(*keys, "level_slots", "values", "holes", "sweep_levels")
    return rows.mapInPandas(lambda frames: _finish_partial(frames, keys, steps),
                            f"{types}, points array<{_POINT}>, unresolved_db array<double>, sweep_levels int")


def dwell_grid(bounds: np.ndarray) -> np.ndarray | None:
    """Number the dwells between ``bounds``: whole median dwells from the first bound on; nothing if a bound lies off the grid."""
    spacing = np.diff(bounds).astype(float)
    dwell = float(np.median(spacing)) if spacing.size else 0.0
    if dwell <= 0:
        return None
    whole = np.floor(spacing / dwell + 0.5).astype(np.int64)
    if (whole < 1).any() or (np.abs(spacing / dwell - whole) > MAX_DWELL_ERROR).any():
        return None
    return np.r_[0, np.cumsum(whole)]


def _place_levels(frames: Iterator[pd.DataFrame], keys: list[str], expected: int) -> Iterator[pd.DataFrame]:
    """Per channel: the step of every measured level (``level_slots``), by the dwells between it and the run's first; channels off the grid drop out."""
    columns = [*keys, "bounds", "slots", "level_slots", "values", "sweep_levels"]
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            kept: list[int] = []
            for mark in row["marks"]:  # a mark a sample or two after the boundary kept last belongs to that boundary
                if not kept or mark - kept[-1] > 2:
                    kept.append(int(mark))
            bounds = np.array(kept, np.int64)
            slots = dwell_grid(bounds)
            if slots is None:
                continue
            measured = [v for v in row["levels"] if v["level_no"] <= row["last"]]
            before = np.searchsorted(bounds, [v["begin"] for v in measured])  # bounds before the level
            at = np.r_[0, slots + 1][before]
            placed = at - at[0]
            if (placed < 0).any() or (placed >= expected).any() or (np.diff(placed) <= 0).any():
                continue
            out.append((*(row[k] for k in keys), bounds.tolist(), (slots - at[0]).tolist(), placed.tolist(), [float(v["value"]) for v in measured],
                        int(row["run_end"] - row["run_begin"] + 1)))
        yield pd.DataFrame(out, columns=columns)


def _finish_partial(frames: Iterator[pd.DataFrame], keys: list[str], steps: list[float]) -> Iterator[pd.DataFrame]:
    """Per channel: fill confirmed holes below the top measured step, in order, each strictly between its measured neighbours."""
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            raw = dict(zip((int(s) for s in row["level_slots"]), (float(v) for v in row["values"])))
            top = max(raw)
            for hole in (row["holes"] if row["holes"] is not None else []):
                slot, level = int(hole["slot"]), float(hole["level"])
                below = [s for s in raw if s < slot]
                above = [s for s in raw if s > slot]
                if slot < 0 or slot >= top or slot in raw or not below or not above:
                    continue
                sides = sorted((raw[max(below)], raw[min(above)]))
                if sides[0] < level < sides[1]:
                    raw[slot] = level
            points = sorted(({"raw_avg": v, "true_db": steps[s]} for s, v in raw.items()), key=lambda p: p["raw_avg"])
            out.append({**{k: row[k] for k in keys}, "points": points, "sweep_levels": row["sweep_levels"],
                        "unresolved_db": [db for s, db in enumerate(steps) if s not in raw]})
        yield pd.DataFrame(out, columns=[*keys, "points", "unresolved_db", "sweep_levels"])


# --- report ---------------------------------------------------------------------------------------------------------------

def calibration_report(results: DataFrame, expected: int, group: list[str] | None = None) -> DataFrame:
    """Per receiver: channels by outcome and what deserves a second look.

    ``results`` has ``name`` and the columns of ``detect_steps``. Receiver 0 collects names without a receiver number.
    """
    group = group or []
    named = results.withColumn("receiver", F.greatest(receiver_number(F.col("name")), F.lit(0)))
    named = named.withColumn("part", F.when(F.col("receiver") > 0, channel_part(F.col("name"))).otherwise(F.col("name")))
    ok, flat = F.col("outcome") == "calibrated", F.col("outcome") == "flat"

    def parts(test: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(test, F.col("part"))))

    top = F.array_max(F.transform("points", lambda p: p.true_db))
    extra = F.when(ok & (F.col("sweep_levels") - expected > MAX_LEAD_IN), F.col("sweep_levels"))
    return named.groupBy(*group, "receiver").agg(
        F.count(F.lit(1)).alias("channels"), parts(ok).alias("calibrated"), parts(ok & F.col("relaxed")).alias("relaxed"),
        parts(ok & F.col("saturated")).alias("saturated"), F.max(F.when(ok & F.col("saturated"), top)).alias("saturated_top_db"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(ok & F.col("saturated"), F.col("unresolved_db")))))).alias("unresolved_db"),
        parts(F.col("outcome") == "no_data").alias("no_data"), parts(flat).alias("flat"),
        F.array_sort(F.collect_set(F.when(flat, F.bround(F.try_element_at("plateau_levels", F.lit(1)), 0)))).alias("flat_levels"),
        parts(F.col("outcome") == "too_few_plateaus").alias("too_few_plateaus"),
        parts(F.col("outcome") == "no_monotonic_sweep").alias("no_monotonic_sweep"),
        F.min(F.when(~ok & (F.col("samples") > 0), F.col("detected_plateaus"))).alias("fewest_plateaus"),
        F.max(extra).alias("step_file_short_levels"),
    ).withColumn("word_map_suspect", (F.col("receiver") > 0) & (F.size("calibrated") > 0) & (F.size("flat") > 0))
