import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.operators import steps as st
from lockstep.operators.calibrate import calibrate_piecewise
from lockstep.operators.scans import exact_median
from lockstep.workload import tables

JITTER = [3600.0 + 6.0 * (i % 2) for i in range(150)]
CASES = {
    "clean": [1000.0] * 150 + [2000.0] * 150 + [3000.0] * 150,
    "two": [1000.0] * 150 + [2000.0] * 150,
    "falling": [3000.0] * 150 + [2000.0] * 150 + [1000.0] * 150,
    "one": [1000.0],
    "flat": [1000.0] * 450,
    "zigzag": [1000.0] * 150 + [2000.0] * 150 + [1000.0] * 150 + [2000.0] * 150,
    "blip": [500.0] * 55 + [1000.0] * 150 + [2000.0] * 150 + [3000.0] * 150,
    "split": [1000.0] * 150 + [2000.0] * 150 + [2020.0] * 150 + [3000.0] * 150,
}


def series(spark, cases):
    rows = [(k, i, v) for k, vs in cases.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "channel string, idx long, raw double")


def detect(spark, cases, steps):
    out = st.detect_steps(series(spark, cases), ["channel"], 0.01, steps)
    return {r.channel: r for r in out.collect()}


def test_sweeps(spark):
    got = detect(spark, CASES, [0.0, 6.0, 12.0])
    points = {k: [(p.raw_avg, p.true_db) for p in r.points] for k, r in got.items()}
    assert points["clean"] == [(1000, 0), (2000, 6), (3000, 12)] and got["clean"].detected_plateaus == 3
    assert not got["clean"].extra_plateaus and not got["clean"].saturated and got["clean"].unresolved_db == []
    assert points["falling"] == [(1000, 12), (2000, 6), (3000, 0)]
    assert points["blip"] == points["clean"]
    assert points["split"] == [(1000, 0), (2020, 6), (3000, 12)] and got["split"].extra_plateaus
    outcomes = {k: r.outcome for k, r in got.items()}
    assert outcomes["one"] == "no_data" and outcomes["flat"] == "flat" and outcomes["two"] == "too_few_plateaus"
    assert outcomes["zigzag"] == "no_monotonic_sweep" and got["two"].detected_plateaus == 2
    assert not got["two"].valid and points["two"] == []
    report = {r.receiver: r for r in st.calibration_report(
        spark.createDataFrame([(f"{p}_RCVR1", *got[c]) for p, c in (("L", "clean"), ("R", "flat"))] + [("odd", *got["two"])],
                              "name string, channel string, " + ", ".join(
            f"{f} {t}" for f, t in (("samples", "long"), ("outcome", "string"), ("valid", "boolean"), ("detected_plateaus", "long"),
                                    ("plateau_levels", "array<double>"), ("edge_threshold", "double"), ("relaxed", "boolean"),
                                    ("saturated", "boolean"), ("sweep_levels", "int"), ("extra_plateaus", "boolean"),
                                    ("unresolved_db", "array<double>"), ("points", "array<struct<raw_avg:double,true_db:double>>")))),
        3).collect()}
    assert report[1].word_map_suspect and report[1].calibrated == ["L"] and report[1].flat == ["R"] and report[1].flat_levels == [1000.0]
    assert report[0].too_few_plateaus == ["odd"] and report[0].fewest_plateaus == 2


def test_extra_levels_and_rails(spark):
    rail = [1000.0] * 150 + [2000.0] * 150 + [3000.0] * 150
    cases = {"rail": rail + [65535.0] * 300, "hole": rail + JITTER + [5000.0] * 150 + [65535.0] * 150,
             "lead": [5000.0] * 150 + rail + [65535.0] * 300, "uneven": rail + [4000.0] * 225 + [65535.0] * 300}
    got = detect(spark, cases, [0.0, 6.0, 12.0, 18.0, 24.0, 30.0])
    points = {k: [(p.raw_avg, p.true_db) for p in r.points] for k, r in got.items()}
    assert got["hole"].saturated and points["hole"] == [(1000, 0), (2000, 6), (3000, 12), (3603, 18), (5000, 24)]
    assert got["hole"].unresolved_db == [30.0]
    assert points["rail"] == [(1000, 0), (2000, 6), (3000, 12)] and got["rail"].unresolved_db == [18.0, 24.0, 30.0]
    assert got["rail"].sweep_levels == 4
    assert points["lead"] == [(1000, 0), (2000, 6), (3000, 12)]
    assert not got["uneven"].valid


def test_extra_level_takes_the_last(spark):
    got = detect(spark, {"clean": CASES["clean"]}, [0.0, 6.0])["clean"]
    assert [(p.raw_avg, p.true_db) for p in got.points] == [(2000, 0), (3000, 6)] and got.extra_plateaus and got.sweep_levels == 3


def test_noise_above_a_step_gives_too_few_plateaus(spark):
    """Noise sets a threshold the first step does not clear, and no lower one makes four clean levels of it."""
    noise = [0.0, 5.0, -5.0, 3.0, -3.0]
    levels = [1000.0, 1030.0, 2000.0, 3000.0]
    values = [v + noise[i % 5] for v in levels for i in range(150)]
    got = detect(spark, {"noisy": values}, [0.0, 6.0, 12.0, 18.0])["noisy"]
    assert got.outcome == "too_few_plateaus" and not got.valid and not got.relaxed


def test_clip_and_interpolation(spark):
    table = series(spark, {"a": [float(i) for i in range(10)]})
    assert [r.raw for r in st.clip(table, ["channel"], 1.0, 2.0, 3.0).orderBy("idx").collect()] == [2, 3, 4, 5, 6]
    ignored = st.clip(table, ["channel"], 1.0, 6.0, 4.0).collect()
    assert len(ignored) == 10 and all(r.clip_ignored for r in ignored)
    points = ("cast(array(struct(0D, 10D), struct(7.5D, 10D), struct(15D, 160D), struct(15D, 170D), struct(20D, 200D)) "
              "as array<struct<raw_avg:double,true_db:double>>)")
    values = [-5.0, 3.0, 7.5, 11.25, 15.0, 17.5, 25.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "raw double").select(
        calibrate_piecewise(F.col("raw"), F.expr(points))).collect()]
    assert got == pytest.approx([10, 10, 10, 85, 160, 185, 200])


def test_median_counts_from_both_ends(spark):
    rows = [("odd", 3.0), ("odd", 1.0), ("odd", 2.0), ("even", 1.0), ("even", 4.0), ("even", 4.0), ("even", 9.0), ("pair", 1.0), ("pair", 1.0), ("pair", 2.0),
            ("pair", 5.0), ("one", 7.0), ("null", None), ("many", 1.0), ("many", 1.0), ("many", 1.0), ("many", 8.0)]
    got = exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m")
    assert {r.k: r.m for r in got.collect()} == {"odd": 2.0, "even": 4.0, "pair": 1.5, "one": 7.0, "many": 1.0}
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()


def test_dwells_are_numbered_by_their_median():
    assert st.dwell_grid(np.array([10, 20, 31, 52])).tolist() == [0, 1, 2, 4]
    assert st.dwell_grid(np.array([10, 20, 30, 45])) is None and st.dwell_grid(np.array([10])) is None and st.dwell_grid(np.array([], int)) is None


def test_samples_of_a_small_table_are_not_sent_to_every_task(spark, monkeypatch):
    """Spark takes what is generated from a table to be as small as the table: joins gathered all samples on the driver."""
    plans, store = [], st.materialize
    monkeypatch.setattr(st, "materialize", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df))[1])
    made = spark.range(6).select(F.col("id").alias("channel"), F.posexplode(F.array(*[F.lit(1000.0 * (i // 15)) for i in range(45)])).alias("idx", "raw"))
    out = st.detect_steps(made, ["channel"], 0.2, [0.0, 6.0, 12.0, 18.0])
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.outcome for r in out.collect()} == {"too_few_plateaus"}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_weighted_median(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 5), ("a", 9.0, 5), ("b", 1.0, 2), ("b", 4.0, 1), ("b", 6.0, 1), ("c", 3.0, 7)]
    got = exact_median(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", "m", "n")
    assert {r.k: r.m for r in got.collect()} == {"a": 2.0, "b": 2.5, "c": 3.0}


def walk(raw, confirm, expected):
    """``outcome, detected plateaus, threshold, relaxed, sweep levels`` of one series by the rule, threshold after threshold; without rails."""
    d, n = np.diff(raw), raw.size
    pinned = (d == 0) & np.isin(raw[:-1], [raw.min(), raw.max()])
    live = d if pinned.all() else d[~pinned]
    sigma = st.MAD_TO_SIGMA * np.median(np.abs(live - np.median(live)))
    nominal, floor = max(6 * sigma, 2.0), max(1.5 * sigma, 2.0)
    best, reached, first = 0, False, None
    for attempt in range(8):
        threshold = nominal * 0.7 ** attempt
        if attempt and threshold < floor:
            break
        moved = np.abs(d) > threshold
        stable = ~(np.r_[moved, False] | np.r_[False, moved])
        cuts = np.flatnonzero(np.diff(np.r_[0, stable, 0])).reshape(-1, 2)
        found = [(b, e) for b, e in cuts if e - b >= confirm]
        first = len(found) if attempt == 0 else first
        levels = [raw[e - confirm: e].mean() for _, e in found]
        for same in (lambda: threshold, lambda: max(threshold, 0.1 * np.median(np.abs(np.diff(levels))) if len(levels) > 1 else 0)):
            tolerance, merged, before = same(), [], None
            for v in levels:
                if before is not None and abs(v - before) <= tolerance:
                    merged.pop()
                merged.append(v)
                before = v
            levels = merged
        best, reached = max(best, len(levels)), reached or len(levels) >= expected
        run, way = 1, 0
        for a, b in [*zip(levels, levels[1:]), (0, 0)]:
            now = int(np.sign(b - a)) if abs(b - a) > threshold else 0
            if now and now == way:
                run += 1
                continue
            if run >= expected:
                return "calibrated", first, threshold, attempt > 0, run
            run, way = 1 + abs(now), now
    return "flat" if best <= 1 else "no_monotonic_sweep" if reached else "too_few_plateaus", first, nominal, False, 0


def test_vectors_with_noise_take_every_threshold(spark, tmp_path):
    """Levels were held for as few samples as their edges make unstable, without noise: all channels were flat after one threshold."""
    rng = np.random.default_rng(3)
    vectors = {k: rng.normal(0, 0.125, 40).astype(np.float32) for k in range(24)}
    spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.channel: r for r in tables.detect_steps(spark, str(tmp_path)).collect()}
    near = lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)
    want = {}
    for k, v in vectors.items():
        other = v.astype(float)[(np.arange(240) * 7 + 3) % 40]
        want[k] = walk(near(np.repeat(v * np.float32(20000) + np.float32(30000), 6).astype(float)) + near(k % 8 * 2000 * other), 3, 3)
    assert {k: (r.outcome, r.detected_plateaus, r.relaxed, r.sweep_levels) for k, r in got.items()} == {k: (*w[:2], *w[3:]) for k, w in want.items()}
    assert {k: r.edge_threshold for k, r in got.items()} == pytest.approx({k: w[2] for k, w in want.items()}, abs=1e-5)
    assert {r.outcome for r in got.values()} >= {"calibrated", "no_monotonic_sweep"} and {r.relaxed for r in got.values()} == {True, False}
