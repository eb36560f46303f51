"""Events as timed samples and packets: a user or an event type is a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.operators import calibrate, lookup, series, windows
from lockstep.operators import steps as st
from lockstep.operators.scans import Carry, cut_at, ordered_scan, quantile_bounds
from lockstep.session import scratch
from lockstep.sources import recording, series_csv, sinks
from lockstep.workload.documents import table

HOUR, MINUTE = 3_600_000_000, 60_000_000
VIEW = 150
POINTS = [(0.0, 0.0), (5.0, 6.0), (5.0, 8.0), (20.0, 12.0), (60.0, 30.0)]
TYPE_CODES = {"view": 1, "click": 9, "purchase": 17, "error": 9, "signup": 17}


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def assign_windows(spark, sf):
    e = events(spark, sf)
    late = e.withColumn("us", F.col("us") - F.col("event_id") % 7 * 10 * MINUTE)
    seed = F.lit(late.agg(F.min_by("us", "event_id")).first()[0])
    out = windows.assign_windows(late, "us", seed, HOUR, ["event_type"], ["event_id"], F.expr("event_id div 1000000"))
    return out.select("event_id", "event_type", "window_idx")


def _hourly(spark, sf, width=HOUR):
    e = events(spark, sf)
    return e.join(e.agg(F.min("us").alias("first")), F.lit(True)).withColumn(
        "window_idx", windows.window_index(F.col("us") - F.col("first"), F.lit(width)))


def window_share(spark, sf):
    out = windows.window_share(_hourly(spark, sf), [], F.col("event_type") != "error")
    return out.select("window_idx", "rows", F.round("share_pct", 6).alias("share_pct"))


def gap_fill(spark, sf):
    per = _hourly(spark, sf, MINUTE).groupBy("window_idx").agg(F.count(F.lit(1)).alias("n"))
    return windows.fill_windows(per, []).select("window_idx", F.coalesce("n", F.lit(0)).alias("n"), "filled")


def accumulated(spark, sf):
    per = _hourly(spark, sf).groupBy("event_type", "window_idx").agg(F.count_if(F.col("value") > 20).alias("n"))
    return windows.accumulate(per, ["event_type"], "n", "so_far")


def drop_tail(spark, sf):
    per = _hourly(spark, sf).groupBy("user_id", "window_idx").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    return windows.drop_empty_tail(per, ["user_id"], "errors")


def channel_window_mean(spark, sf):
    full = windows.fill_windows(_hourly(spark, sf).select("event_type", "window_idx", "value"), ["event_type"])
    out = windows.window_mean(full, ["event_type"], "value")
    return out.select("event_type", "window_idx", "n", F.round("raw_mean", 6).alias("raw_mean"))


def calibrate_linear(spark, sf):
    e = events(spark, sf).withColumns({"polarity": (F.col("user_id") % 2).cast("int"), "slope_idx": (F.col("user_id") % 4).cast("int")})
    slope, offset = calibrate.linear_coefficients(F.col("polarity"), F.col("slope_idx"), F.lit(20.0))
    return e.select("event_id", F.round(calibrate.calibrate_linear(F.col("value") * 1000, slope, offset), 6).alias("db"))


def _points():
    return F.array(*[F.struct(F.lit(a).alias("raw_avg"), F.lit(b).alias("true_db")) for a, b in POINTS])


def calibrate_piecewise(spark, sf):
    return events(spark, sf).select("event_id", F.round(calibrate.calibrate_piecewise(F.col("value"), _points()), 6).alias("db"))


def calibrate_sql(spark, sf):
    calibrate.register_functions(spark)
    e = events(spark, sf).withColumn("points", _points())
    return e.selectExpr("event_id", "round(calibrate_linear(value, 2.0D, 3.0D), 6) AS linear", "round(calibrate_piecewise(value, points), 6) AS db")


def calibration_report(spark, sf):
    """Users' event types stand in for channels of a receiver."""
    per = events(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    outcome = (F.when(F.col("n") % 5 == 0, "flat").when(F.col("n") % 5 == 1, "too_few_plateaus").when(F.col("n") % 5 == 2, "no_monotonic_sweep")
               .otherwise("calibrated"))
    results = per.select(
        F.concat(F.col("event_type"), F.lit("_RCVR"), F.col("user_id").cast("string")).alias("name"), F.col("n").alias("samples"), outcome.alias("outcome"),
        (F.col("n") % 3 == 0).alias("relaxed"), (F.col("n") % 4 == 0).alias("saturated"), (F.col("n") % 7).cast("int").alias("sweep_levels"),
        F.array(F.col("top")).alias("unresolved_db"), F.array(F.col("top")).alias("plateau_levels"), F.col("n").alias("detected_plateaus"),
        F.array(F.struct(F.lit(0.0).alias("raw_avg"), F.col("top").alias("true_db"))).alias("points"))
    out = st.calibration_report(results, 3)
    text = ["calibrated", "relaxed", "saturated", "flat", "too_few_plateaus", "no_monotonic_sweep"]
    return out.select("receiver", "channels", *[F.array_join(c, ",").alias(c) for c in text], "saturated_top_db", "fewest_plateaus",
                      "step_file_short_levels", "word_map_suspect")


def recording_gates(spark, sf):
    code = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])
    p = events(spark, sf).select(F.col("user_id").alias("source_id"), F.col("event_id").alias("file_offset"),
                                 F.coalesce(code[F.col("event_type")], F.lit(0)).alias("data_type"),
                                 (F.col("value") * 1_000_000).cast("long").alias("packet_len"))
    return recording.recording_gates(p)


def packet_census(spark, sf):
    return recording.packet_census(events(spark, sf), [], "event_type", "user_id")


def packet_time(spark, sf):
    """Purchases carry the time; every other event takes its offset from the last purchase of its user."""
    e = events(spark, sf).select(F.col("user_id").alias("source_id"), F.col("event_id").alias("file_offset"), "event_type",
                                 (F.col("event_id") * 1000).alias("rel_time_100ns"), (F.col("us") * 10).alias("abs_ticks"))
    packets, times = e.where("event_type <> 'purchase'").drop("abs_ticks"), e.where("event_type = 'purchase'")
    return recording.packet_time(packets, times).select("source_id", "file_offset", "base_ticks")


def time_gaps(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("source_id"), F.col("event_id").alias("file_offset"), (F.col("us") * 10).alias("abs_ticks"))
    return recording.time_gaps(e, limit=600 * 10_000_000)


def _series(spark, sf):
    """Event values as lock, missed and level series of users' days."""
    e = events(spark, sf)
    metric = F.when(F.col("event_type") == "view", "lock").when(F.col("event_type") == "click", "missed").otherwise("level")
    return e.select("event_id", metric.alias("metric"), (F.col("user_id") % 4).cast("int").alias("source_id"), (F.col("us") / 1e6).alias("t_abs"), "value")


def filter_view(spark, sf):
    return series.filter_view(_series(spark, sf), "missed", 2).select("event_id", "metric")


def align_elapsed(spark, sf):
    return series.align_elapsed(_series(spark, sf)).select("event_id", F.round("elapsed", 6).alias("elapsed"))


def time_base(spark, sf):
    out = series.time_base(_series(spark, sf))
    return out.select(F.round("base_s", 6).alias("base_s"), "base_day", F.round("base_offset", 6).alias("base_offset"))


def slice_time(spark, sf):
    return series.slice_time(series.align_elapsed(_series(spark, sf)), 86_400.0, 1e9).select("event_id", "metric")


def slice_limits(spark, sf):
    out = series.slice_limits(series.align_elapsed(_series(spark, sf)), -5.0, 1e9)
    return out.select(F.round("x_max", 6).alias("x_max"), "start", F.round("stop", 6).alias("stop"), "start_clamped", "stop_clamped", "stop_before_start")


def slice_with_neighbours(spark, sf):
    e = series.align_elapsed(events(spark, sf).withColumn("t_abs", F.col("us") / 1e6))
    return series.slice_with_neighbours(e, ["user_id"], ["elapsed", "event_id"], 500_000.0, 700_000.0).select("user_id", "event_id")


def series_range(spark, sf):
    e = events(spark, sf).withColumn("value", F.when(F.col("event_id") % 97 == 0, float("nan")).otherwise(F.col("value")))
    out = series.series_range(e, ["user_id"], "event_id")
    return out.select("user_id", F.when(~F.isnan("y_min"), F.col("y_min")).alias("y_min"), "y_max")


def source_overlap(spark, sf):
    days = events(spark, sf).select(F.col("user_id").alias("source_id"), (F.col("us") / 1e6).alias("t_abs"))
    spans = series.source_spans(days.withColumn("source_id", F.col("source_id") * 40 + F.floor(F.col("t_abs") / 86400) % 40))
    return series.source_overlap(spans, spans)


def source_list(spark, sf):
    parts = [_series(spark, sf).where(F.col("source_id") == i) for i in range(4)]
    labels = spark.createDataFrame([(1, "first.ch10")], "source_id int, label string")
    merged = series.union_sources(parts)
    return series.source_list(merged, labels).join(merged.groupBy("source_id").agg(F.count(F.lit(1)).alias("points")), "source_id")


def _user_days(spark, sf):
    """A user's day is a recording with that day's event types as channels."""
    return events(spark, sf).withColumn("source_id", F.col("user_id") * 40 + F.expr(f"us div {24 * HOUR}") % 40)


def match_template(spark, sf):
    files = _user_days(spark, sf).select("source_id", F.col("event_type").alias("channel_id"))
    template = spark.createDataFrame([("t", "view"), ("t", "click"), ("t", "purchase")], "template string, channel_id string")
    out = series.match_template(template, files, template="t")
    return out.select("source_id", "template", "ok", series.describe_match(F.col("missing"), F.col("extra")).alias("reason"))


def apply_template(spark, sf):
    e = _user_days(spark, sf)
    ids = F.create_map(*[F.lit(x) for kv in zip(("view", "click", "purchase", "error", "signup"), range(11, 16)) for x in kv])
    channels = e.select("source_id", ids[F.col("event_type")].alias("channel_id")).distinct().where("channel_id is not null")
    channels = channels.withColumn("type", F.when(F.col("channel_id") == 15, "TIMEIN").otherwise("PCMIN"))
    recordings = e.select("source_id").distinct().withColumn("path", F.concat(F.lit("r"), F.col("source_id").cast("string")))
    entries = spark.createDataFrame([("t", 11, True, 800), ("t", 12, False, 64), ("t", 13, True, 128)], "template string, channel_id int, process boolean, bits_in_frame int")
    runs, skipped = series.apply_template(recordings, channels, entries, 0, "t")
    took = runs.select("source_id", F.concat_ws(":", F.lit("run"), "channel_id", "bits_in_frame", "time_channel_id").alias("what"))
    return took.unionByName(skipped.select("source_id", F.concat(F.lit("skip:"), F.col("reason")).alias("what")))


def nearest_sample(spark, sf):
    e = events(spark, sf)
    points = e.where("event_type <> 'error'").select((F.col("user_id") % 5).cast("int").alias("series_no"), F.col("event_id").alias("idx"), F.col("us").alias("x"), "value")
    probes = e.where("event_type = 'error'").select(F.col("event_id").alias("probe_id"), F.col("us").alias("x"))
    out = lookup.nearest_sample(points, probes)
    return out.select("probe_id", "series_no", "idx", "value", F.col("distance").cast("long").alias("distance"))


def nearest_pinned(spark, sf):
    e = events(spark, sf)
    points = e.where("event_type <> 'error'").select(F.col("user_id").alias("series_no"), F.col("event_id").alias("idx"), F.col("us").alias("x"), "value")
    probes = e.where("event_type = 'error'").select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("series_no"), F.col("us").alias("x"))
    out = lookup.nearest_sample(points, probes, pinned=True)
    return out.select("probe_id", "series_no", "idx", F.col("distance").cast("long").alias("distance"))


def asof(spark, sf):
    """Each event with the latest order placed by its day's start, twenty-five years on; quantile chunks, as order dates are uneven."""
    o = table(spark, sf, "orders").select((F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.lit(25 * 365 * 24 * HOUR)).alias("us"), F.col("o_orderkey").alias("seq"), "o_orderkey")
    o = o.groupBy("us").agg(F.max("o_orderkey").alias("o_orderkey"))
    e = events(spark, sf).select("us", "event_id")
    return lookup.asof_backward(e, o, [], ["us"], ["o_orderkey"], rows_per_chunk=250_000).select("event_id", "o_orderkey")


def _long(spark, sf):
    e = events(spark, sf).withColumn("value", F.when(F.col("event_id") % 997 == 0, float("nan")).otherwise(F.col("value")))
    return e.select(F.lit(1).alias("series_no"), F.col("event_id").alias("idx"), F.col("us").cast("double").alias("x"), "value")


def envelope(spark, sf):
    p = _long(spark, sf)
    lo, hi = p.agg(F.min("x"), F.max("x")).first()
    out = lookup.envelope_or_raw(p, ["series_no"], lo, hi, 1000)
    return out.select("decimated", "run", "column", "n", "x", "y_min", "y_max", F.round("y_mean", 6).alias("y_mean"))


def indexed_envelope(spark, sf):
    """The middle two thirds of the view of `envelope`, from a stored index and samples stored by slab."""
    p = _long(spark, sf).select("series_no", "idx", "x", "value")
    lo, hi = p.agg(F.min("x"), F.max("x")).first()
    level = 3  # slabs of 256 samples, to have many of them on small tables
    p = p.withColumn("slab", F.expr(f"idx div {lookup.BLOCK << level}"))
    where = scratch(spark, "view")
    p.repartition("slab").write.partitionBy("slab").parquet(where + "/samples")
    lookup.write_view_index(lookup.view_index(p, ["series_no"], slab_level=level), where + "/index")
    stored = spark.read.parquet(where + "/samples").withColumn("slab", F.col("slab").cast("long"))
    out = lookup.indexed_envelope(stored, lookup.read_view_index(spark, where + "/index"), ["series_no"], lo + (hi - lo) / 6, hi - (hi - lo) / 6, VIEW,
                                  slab_level=level, slab="slab")
    return out.select("decimated", "run", "column", "n", "x", "y_min", "y_max", F.round("y_mean", 6).alias("y_mean"))


def calibrate_by_points(spark, sf):
    """Prices as raw counts on five profiles of as many points as there are orders; words 5 and 6 have none."""
    o = table(spark, sf, "orders").where("o_totalprice is not null")
    points = o.select((F.col("o_orderkey") % 5).alias("word"), (F.col("o_totalprice") / 4).alias("raw_avg"), (F.col("o_orderkey") % 997).cast("double").alias("true_db"),
                      F.col("o_orderkey").alias("_n"))
    # points are numbered in the order of their counts
    cut_points, cut = cut_at(points, "raw_avg", quantile_bounds(points, "raw_avg"))
    numbered = ordered_scan(cut_points, ["word"], ["raw_avg", "_n"], [Carry("i", F.lit(1), "count", inclusive=False)], cut)
    counts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 7).alias("word"), F.col("l_extendedprice").alias("raw"))
    out = calibrate.calibrate_by_points(counts, numbered.select("word", "i", "raw_avg", "true_db"))
    return out.select("l_orderkey", "l_linenumber", "word", F.round("db", 4).alias("db"))


def rollup_index(spark, sf):
    out = lookup.rollup_index(_long(spark, sf), ["series_no"])
    return out.select("level", "node", "y_min", "y_max", F.round("y_sum", 4).alias("y_sum"))


def summarize_range(spark, sf):
    p = _long(spark, sf)
    q = p.unionByName(p.withColumns({"series_no": F.lit(2), "value": -F.col("value")}))
    out = lookup.summarize_range(q, lookup.rollup_index(q, ["series_no"]), ["series_no"], 37, 7013)
    return out.select("series_no", "y_min", "y_max", F.round("y_sum", 4).alias("y_sum"))


def is_sorted(spark, sf):
    p = events(spark, sf).withColumn("x", F.col("us") - F.when(F.col("event_id") % 131 == 0, HOUR).otherwise(0).cast("long"))
    return lookup.is_sorted_series(p.withColumn("x", F.col("x").cast("double")), ["user_id"], ["event_id"], "x", F.expr("event_id div 1000000"))


def _export(spark, sf):
    """Every event as a sample of its type's series, on the table's own clock; types (null last, as one of its own) are numbered by name."""
    e = events(spark, sf)
    kinds = [r.event_type for r in e.select("event_type").distinct().orderBy(F.asc_nulls_last("event_type")).collect()]  # columns of the export
    table_ = spark.createDataFrame([(i, "lock" if i < 2 else "level", (k or "none") if i < 2 else f"{i} - L_{k or 'none'} C_RCVR{i}", i % 2, k)
                                    for i, k in enumerate(kinds)], "series_no int, metric string, name string, source_id int, event_type string")
    aligned = series.align_elapsed(e.withColumn("t_abs", F.col("us") / 1e6))
    points = aligned.alias("e").join(table_.alias("t"), F.col("e.event_type").eqNullSafe(F.col("t.event_type")))
    return points.select("series_no", "elapsed", F.col("event_id").alias("sample_no"), "value"), table_.drop("event_type")


def csv_rows(spark, sf):
    points, names = _export(spark, sf)
    return series_csv.csv_rows(points, names.count(), F.lit(1), F.lit(0.0)).select("ms", "line")


def csv_round_trip(spark, sf, encoding="UTF-8"):
    points, names = _export(spark, sf)
    path = scratch(spark, "export")
    series_csv.write_series_csv(points, names, 1, 0.0, path, encoding)
    out, files = series_csv.read_series_csv(spark, path, one_export=True)
    return out.select("metric", "name", "source_id", "receiver", "channel", F.round("elapsed", 3).alias("elapsed"), "value")


def utf16_round_trip(spark, sf):
    return csv_round_trip(spark, sf, "UTF-16LE")


def per_source(spark, sf):
    path = scratch(spark, "per-source")
    sinks.write_per_source(_series(spark, sf), path)
    return sinks.read_samples(spark, path).groupBy(F.col("source_id").cast("int").alias("source_id")).agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 4).alias("total"))


def durable_samples(spark, sf):
    path = scratch(spark, "samples")
    s = _series(spark, sf).withColumns({"stream_seq": F.lit(0), "name": F.col("metric"), "elapsed": F.col("t_abs")})
    sinks.write_samples(s, path)
    return sinks.read_samples(spark, path).groupBy("source_id", "metric").agg(F.count(F.lit(1)).alias("points"), F.round(F.max("elapsed"), 6).alias("last"))


QUERIES = {
    "W1_assign_windows": assign_windows, "W4_window_share": window_share, "W5_gap_fill": gap_fill, "W6_accumulated": accumulated, "W7_drop_empty_tail": drop_tail,
    "W8_channel_window_mean": channel_window_mean, "C1_calibrate_linear": calibrate_linear, "C2_calibrate_piecewise": calibrate_piecewise,
    "C2_sql_functions": calibrate_sql, "E17_calibration_report": calibration_report, "S3_recording_gates": recording_gates, "S4_packet_census": packet_census,
    "S6_packet_time": packet_time, "S7_time_gaps": time_gaps, "P8_filter_view": filter_view, "T6_align_elapsed": align_elapsed, "T6_time_base": time_base,
    "P9_slice_time": slice_time, "P9_slice_limits": slice_limits, "P10_slice_with_neighbours": slice_with_neighbours, "T4_series_range": series_range,
    "T7_source_overlap": source_overlap, "T12_union_sources": source_list, "T13_match_template": match_template, "T14_apply_template": apply_template,
    "V1_nearest_sample": nearest_sample, "V1_nearest_pinned": nearest_pinned, "S6_asof_orders": asof, "V4_envelope": envelope, "V4_indexed_envelope": indexed_envelope, "C2_wide_profiles": calibrate_by_points, "V5_rollup_index": rollup_index,
    "V6_summarize_range": summarize_range, "V7_is_sorted_series": is_sorted, "K1_csv_rows": csv_rows, "S9_csv_round_trip": csv_round_trip, "S9_utf16_round_trip": utf16_round_trip,
    "K3_write_per_source": per_source, "K4_write_samples": durable_samples,
}

_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
_H = f"{_E}, h AS (SELECT *, greatest(0, ceil((us - (SELECT min(us) FROM e)) / {HOUR}.0) - 1)::BIGINT AS w FROM e)"
_S = ("s AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'lock' WHEN 'click' THEN 'missed' ELSE 'level' END AS metric, user_id % 4 AS source_id, "
      "epoch_us(ts) / 1e6 AS t_abs, value FROM events)")
_A = f"{_S}, a AS (SELECT *, t_abs - (SELECT min(t_abs) FROM s) AS elapsed FROM s)"
_PIECES = " ".join(f"WHEN value <= {b[0]} THEN {a[1]} + ({b[1]} - {a[1]}) / nullif({b[0]} - {a[0]}, 0) * (value - {a[0]})" for a, b in zip(POINTS, POINTS[1:]) if a[0] != b[0])
_PIECEWISE = f"CASE WHEN value <= 0 THEN 0.0 WHEN value >= 60 THEN 30.0 {_PIECES} END"
_CODE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_CODES.items()) + " ELSE 0 END"


def _names(test: str) -> str:
    return f"coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER ({test}), '')"


_POINTS_SQL = "SELECT {s} AS s, event_id AS i, us AS x, value FROM e WHERE event_type <> 'error'"
_CELLS = (f"WITH {_E}, k AS (SELECT (row_number() OVER (ORDER BY event_type NULLS LAST) - 1)::INT AS i, event_type, coalesce(event_type, 'none') AS kind FROM (SELECT DISTINCT event_type FROM e)), "
          "c AS (SELECT floor((us / 1e6 - (SELECT min(us / 1e6) FROM e)) * 1000 + 0.5)::BIGINT AS ms, i, arg_max(value, event_id) AS v "
          "FROM e JOIN k ON e.event_type IS NOT DISTINCT FROM k.event_type GROUP BY ALL)")
_LONG = f"{_E}, p AS (SELECT event_id AS idx, us::DOUBLE AS x, value, event_id % 997 = 0 AS bad FROM e)"

ORACLES = {
    "W1_assign_windows": f"WITH {_E}, l AS (SELECT *, us - event_id % 7 * {10 * MINUTE} AS t FROM e) SELECT event_id, event_type, max(greatest(0, ceil((t - (SELECT arg_min(t, event_id) FROM l)) / {HOUR}.0) - 1)::BIGINT) OVER (PARTITION BY event_type ORDER BY event_id) AS window_idx FROM l",
    "W4_window_share": f"WITH {_H} SELECT w AS window_idx, count(*) AS rows, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS share_pct FROM h GROUP BY w",
    "W5_gap_fill": f"WITH {_E}, h AS (SELECT greatest(0, ceil((us - (SELECT min(us) FROM e)) / {MINUTE}.0) - 1)::BIGINT AS w FROM e), g AS (SELECT w, count(*) AS n FROM h GROUP BY w) SELECT r.w AS window_idx, coalesce(n, 0) AS n, n IS NULL AS filled FROM (SELECT unnest(range(0, (SELECT max(w) FROM g) + 1)) AS w) r LEFT JOIN g USING (w)",
    "W6_accumulated": f"WITH {_H}, g AS (SELECT event_type, w, count(*) FILTER (value > 20) AS n FROM h GROUP BY event_type, w) SELECT event_type, w AS window_idx, n, (sum(n) OVER (PARTITION BY event_type ORDER BY w))::BIGINT AS so_far FROM g",
    "W7_drop_empty_tail": f"WITH {_H}, g AS (SELECT user_id, w, count(*) FILTER (event_type = 'error') AS errors FROM h GROUP BY user_id, w) SELECT user_id, w AS window_idx, errors FROM g QUALIFY errors > 0 OR w < max(w) OVER (PARTITION BY user_id)",
    "W8_channel_window_mean": f"WITH {_H}, g AS (SELECT event_type, w, count(value) AS n, avg(value) AS m FROM h GROUP BY event_type, w), r AS (SELECT event_type, unnest(range(0, max(w) + 1)) AS w FROM h GROUP BY event_type) SELECT event_type, w AS window_idx, coalesce(n, 0) AS n, round(coalesce(m, 0.0), 6) AS raw_mean FROM r LEFT JOIN g USING (event_type, w)",
    "C1_calibrate_linear": "WITH v AS (SELECT event_id, value * 1000 AS raw, user_id % 2 = 1 AS neg, list_extract([-10.0, -5.0, 0.0, 0.0], user_id % 4 + 1)::DOUBLE * 20 AS lo, list_extract([10.0, 5.0, 10.0, 5.0], user_id % 4 + 1)::DOUBLE * 20 AS hi FROM events) SELECT event_id, round((raw + CASE WHEN neg THEN -hi ELSE lo END / (hi - lo) * 65535) * ((hi - lo) / 65535 * CASE WHEN neg THEN -1 ELSE 1 END), 6) AS db FROM v",
    "C2_calibrate_piecewise": f"SELECT event_id, round({_PIECEWISE}, 6) AS db FROM events",
    "C2_sql_functions": f"SELECT event_id, round((value + 3) * 2, 6) AS linear, round({_PIECEWISE}, 6) AS db FROM events",
    "E17_calibration_report": f"""WITH p AS (SELECT user_id, event_type, count(*) AS n, max(value) AS top, CASE count(*) % 5 WHEN 0 THEN 'flat' WHEN 1 THEN 'too_few_plateaus' WHEN 2 THEN 'no_monotonic_sweep' ELSE 'calibrated' END AS o FROM events GROUP BY user_id, event_type),
        q AS (SELECT user_id AS uid, CASE WHEN user_id > 0 THEN event_type ELSE event_type || '_RCVR0' END AS event_type, n, top, o FROM p)
        SELECT uid AS receiver, count(*) AS channels, {_names("o = 'calibrated'")} AS calibrated, {_names("o = 'calibrated' AND n % 3 = 0")} AS relaxed, {_names("o = 'calibrated' AND n % 4 = 0")} AS saturated, {_names("o = 'flat'")} AS flat,
        {_names("o = 'too_few_plateaus'")} AS too_few_plateaus, {_names("o = 'no_monotonic_sweep'")} AS no_monotonic_sweep, max(top) FILTER (o = 'calibrated' AND n % 4 = 0) AS saturated_top_db, min(n) FILTER (o <> 'calibrated') AS fewest_plateaus,
        max(n % 7) FILTER (o = 'calibrated' AND n % 7 > 4) AS step_file_short_levels, uid > 0 AND count(*) FILTER (o = 'calibrated') > 0 AND count(*) FILTER (o = 'flat') > 0 AS word_map_suspect FROM q GROUP BY uid""",
    "S3_recording_gates": f"WITH f AS (SELECT user_id AS source_id, arg_min({_CODE}, event_id) AS t, max((value * 1000000)::BIGINT) AS len, bool_or({_CODE} = 9) AS pcm, bool_or({_CODE} = 17) AS tm FROM events GROUP BY user_id) SELECT source_id, 'first_packet_not_tmats' AS gate FROM f WHERE t <> 1 UNION ALL SELECT source_id, 'packet_too_large' FROM f WHERE len > 104857600 UNION ALL SELECT source_id, 'no_pcm' FROM f WHERE NOT pcm UNION ALL SELECT source_id, 'no_time' FROM f WHERE NOT tm",
    "S4_packet_census": "WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id) SELECT event_type, (sum(n) OVER t)::BIGINT AS packets, count(*) OVER t AS channels, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place, user_id, n FROM c WINDOW t AS (PARTITION BY event_type)",
    "S6_packet_time": f"WITH {_E}, x AS (SELECT *, CASE WHEN event_type = 'purchase' THEN us * 10 - event_id * 1000 END AS shift FROM e) SELECT user_id AS source_id, event_id AS file_offset, event_id * 1000 + coalesce(s, f) AS base_ticks FROM (SELECT *, last_value(shift IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS s, first_value(shift IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM x) WHERE event_type <> 'purchase'",
    "S7_time_gaps": f"WITH {_E}, g AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM e) SELECT user_id AS source_id, count(*) FILTER (d > 600000000) AS gaps FROM g GROUP BY user_id",
    "P8_filter_view": f"WITH {_S} SELECT event_id, metric FROM s WHERE metric IN ('missed', 'level') AND source_id = 2",
    "T6_align_elapsed": f"WITH {_A} SELECT event_id, round(elapsed, 6) AS elapsed FROM a",
    "T6_time_base": "SELECT round(min(epoch_us(ts)) / 1e6, 6) AS base_s, dayofyear(min(ts)) AS base_day, round(min(epoch_us(ts)) / 1e6 - floor(min(epoch_us(ts)) / 1e6 / 86400) * 86400, 6) AS base_offset FROM events",
    "P9_slice_time": f"WITH {_A} SELECT event_id, metric FROM a WHERE elapsed >= 86400",
    "P9_slice_limits": f"WITH {_A} SELECT round(max(elapsed), 6) AS x_max, 0.0 AS start, round(max(elapsed), 6) AS stop, true AS start_clamped, true AS stop_clamped, false AS stop_before_start FROM a",
    "P10_slice_with_neighbours": f"WITH {_E}, t AS (SELECT user_id, event_id, us / 1e6 - (SELECT min(us / 1e6) FROM e) AS x FROM e) SELECT user_id, event_id FROM t QUALIFY x BETWEEN 500000 AND 700000 OR (x < 500000 AND coalesce(lead(x) OVER (PARTITION BY user_id ORDER BY x, event_id) >= 500000, true)) OR (x > 700000 AND coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) <= 700000, true))",
    "T4_series_range": "WITH v AS (SELECT user_id, event_id, value, event_id % 97 = 0 AS bad FROM events), l AS (SELECT user_id, max(event_id) FILTER (bad) AS ln FROM v GROUP BY user_id) SELECT user_id, min(value) FILTER (NOT bad AND (ln IS NULL OR event_id > ln)) AS y_min, max(value) FILTER (NOT bad) AS y_max FROM v JOIN l USING (user_id) GROUP BY user_id",
    "T7_source_overlap": f"WITH {_E}, s AS (SELECT (user_id * 40 + (us // {24 * HOUR}) % 40)::BIGINT AS source_id, min(us) AS f, max(us) AS l FROM e GROUP BY 1) SELECT a.source_id, count(b.source_id) AS overlaps, count(b.source_id) > 0 AS overlapping FROM s a LEFT JOIN s b ON a.source_id <> b.source_id AND a.f <= b.l AND b.f <= a.l GROUP BY a.source_id",
    "T12_union_sources": "SELECT user_id % 4 AS source_id, CASE WHEN user_id % 4 = 1 THEN 'first.ch10' ELSE 'Source ' || (user_id % 4) END AS label, count(*) AS points FROM events GROUP BY 1, 2",
    "T13_match_template": "WITH f AS (SELECT (user_id * 40 + (epoch_us(ts) // 86400000000) % 40)::BIGINT AS source_id, list(DISTINCT event_type) AS p FROM events GROUP BY 1), d AS (SELECT source_id, list_sort(list_filter(['view', 'click', 'purchase'], lambda x: NOT list_contains(p, x))) AS m, list_sort(list_filter(p, lambda x: NOT list_contains(['view', 'click', 'purchase'], x))) AS x FROM f) SELECT source_id, 't' AS template, len(m) = 0 AND len(x) = 0 AS ok, concat_ws(' ', CASE WHEN len(m) > 0 THEN 'missing=' || array_to_string(m, ',') END, CASE WHEN len(x) > 0 THEN 'extra=' || array_to_string(x, ',') END) AS reason FROM d",
    "T14_apply_template": """WITH i(event_type, id) AS (VALUES ('view', 11), ('click', 12), ('purchase', 13), ('error', 14), ('signup', 15)),
        f AS (SELECT (user_id * 40 + (epoch_us(ts) // 86400000000) % 40)::BIGINT AS source_id, list_sort(coalesce(list(DISTINCT id) FILTER (id < 15), [])) AS p, bool_or(id = 15) AS tm, bool_or(id < 15) AS any_pcm FROM events LEFT JOIN i USING (event_type) GROUP BY 1),
        d AS (SELECT *, list_filter([11, 12, 13], lambda x: NOT list_contains(p, x)) AS m, list_filter(p, lambda x: x > 13) AS x FROM f)
        SELECT source_id, 'run:' || ch || ':' || bits || ':' || CASE WHEN tm THEN 15 ELSE -1 END AS what FROM d, (VALUES (11, 800), (13, 128)) t(ch, bits) WHERE len(m) = 0 AND len(x) = 0
        UNION ALL SELECT source_id, 'skip:' || CASE WHEN NOT coalesce(any_pcm, false) THEN 'no_channels' ELSE concat_ws(' ', CASE WHEN len(m) > 0 THEN 'missing=' || array_to_string(m, ',') END, CASE WHEN len(x) > 0 THEN 'extra=' || array_to_string(x, ',') END) END FROM d WHERE len(m) > 0 OR len(x) > 0""",
    "V1_nearest_sample": f"""WITH {_E}, p AS ({_POINTS_SQL.format(s='user_id % 5')}), q AS (SELECT event_id AS probe_id, us FROM e WHERE event_type = 'error'),
        lo0 AS (SELECT x, arg_max(i, (-s, i)) AS i, min(s) AS s FROM p GROUP BY x), hi0 AS (SELECT x, arg_min(i, (s, i)) AS i, min(s) AS s FROM p GROUP BY x),
        lo AS (SELECT q.probe_id, q.us, l.x, l.s, l.i FROM q ASOF LEFT JOIN lo0 l ON q.us > l.x), hi AS (SELECT q.probe_id, h.x, h.s, h.i FROM q ASOF LEFT JOIN hi0 h ON q.us <= h.x),
        b AS (SELECT probe_id, us, lo.x AS lx, lo.s AS ls, lo.i AS li, hi.x AS hx, hi.s AS hs, hi.i AS hi, hi.x IS NOT NULL AND (lo.x IS NULL OR hi.x - us < us - lo.x OR (hi.x - us = us - lo.x AND hi.s <= lo.s)) AS up FROM lo JOIN hi USING (probe_id)),
        r AS (SELECT probe_id, CASE WHEN up THEN hs ELSE ls END AS series_no, CASE WHEN up THEN hi ELSE li END AS idx, CASE WHEN up THEN hx - us ELSE us - lx END AS distance FROM b WHERE hx IS NOT NULL OR lx IS NOT NULL)
        SELECT probe_id, series_no, idx, value, distance FROM r JOIN events ON event_id = idx""",
    "V1_nearest_pinned": f"""WITH {_E}, p AS ({_POINTS_SQL.format(s='user_id')}), q AS (SELECT event_id AS probe_id, user_id, us FROM e WHERE event_type = 'error'),
        lo AS (SELECT q.probe_id, q.user_id, q.us, l.x, l.i FROM q ASOF LEFT JOIN p l ON q.user_id = l.s AND q.us > l.x), hi AS (SELECT q.probe_id, h.x, h.i FROM q ASOF LEFT JOIN p h ON q.user_id = h.s AND q.us <= h.x),
        b AS (SELECT probe_id, user_id, us, lo.x AS lx, lo.i AS li, hi.x AS hx, hi.i AS hi, hi.x IS NOT NULL AND (lo.x IS NULL OR hi.x - us <= us - lo.x) AS up FROM lo JOIN hi USING (probe_id))
        SELECT probe_id, user_id AS series_no, CASE WHEN up THEN hi ELSE li END AS idx, CASE WHEN up THEN hx - us ELSE us - lx END AS distance FROM b WHERE hx IS NOT NULL OR lx IS NOT NULL""",
    "S6_asof_orders": f"WITH {_E}, o AS (SELECT epoch_us(o_orderdate) + {25 * 365 * 24 * HOUR} AS us, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT event_id, o_orderkey FROM e ASOF LEFT JOIN o ON e.us >= o.us",
    "V4_envelope": f"WITH {_LONG}, r AS (SELECT *, sum(bad::INT) OVER (ORDER BY idx)::BIGINT AS run, least(999, floor((x - (SELECT min(x) FROM p)) / ((SELECT max(x) FROM p) - (SELECT min(x) FROM p)) * 1000))::BIGINT AS col FROM p) SELECT true AS decimated, run, col AS \"column\", count(*) AS n, arg_min(x, idx) AS x, min(value) AS y_min, max(value) AS y_max, round(avg(value), 6) AS y_mean FROM r WHERE NOT bad AND (SELECT count(*) FROM p) > 2000 GROUP BY run, col UNION ALL SELECT false, NULL, NULL, 1, x, value, value, round(value, 6) FROM p WHERE NOT bad AND (SELECT count(*) FROM p) <= 2000",
    "V4_indexed_envelope": f"""WITH {_LONG}, v AS (SELECT min(x) + (max(x) - min(x)) / 6 AS lo, max(x) - (max(x) - min(x)) / 6 AS hi FROM p),
        q AS (SELECT p.*, lo, hi FROM p, v WHERE x BETWEEN lo AND hi OR idx = (SELECT max(idx) FROM p, v WHERE x < lo) OR idx = (SELECT min(idx) FROM p, v WHERE x > hi)),
        r AS (SELECT *, sum(bad::INT) OVER (ORDER BY idx)::BIGINT AS run, CASE WHEN x < lo THEN -1 WHEN x > hi THEN {VIEW} ELSE least({VIEW - 1}, floor((x - lo) / (hi - lo) * {VIEW})) END::BIGINT AS col FROM q)
        SELECT true AS decimated, run, col AS "column", count(*) AS n, arg_min(x, idx) AS x, min(value) AS y_min, max(value) AS y_max, round(avg(value), 6) AS y_mean
        FROM r WHERE NOT bad AND (SELECT count(*) FROM q) > {2 * VIEW} GROUP BY run, col
        UNION ALL SELECT false, NULL, NULL, 1, x, value, value, round(value, 6) FROM q WHERE NOT bad AND (SELECT count(*) FROM q) <= {2 * VIEW}""",
    "C2_wide_profiles": """WITH o AS (SELECT o_orderkey % 5 AS word, o_totalprice / 4 AS raw, (o_orderkey % 997)::DOUBLE AS db, o_orderkey AS k FROM orders WHERE o_totalprice IS NOT NULL),
        l AS (SELECT word, raw, arg_max(db, k) AS low, arg_min(db, k) AS high FROM o GROUP BY word, raw), t AS (SELECT word, arg_max(raw, raw) AS top, arg_max(low, raw) AS top_db FROM l GROUP BY word),
        c AS (SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS word, l_extendedprice AS raw FROM lineitem)
        SELECT l_orderkey, l_linenumber, c.word, round(CASE WHEN t.top IS NULL THEN NULL WHEN a.raw IS NULL THEN b.high WHEN c.raw >= top THEN top_db
            ELSE a.low + (b.high - a.low) / (b.raw - a.raw) * (c.raw - a.raw) END, 4) AS db
        FROM c ASOF LEFT JOIN l a ON c.word = a.word AND c.raw > a.raw ASOF LEFT JOIN l b ON c.word = b.word AND c.raw <= b.raw LEFT JOIN t ON t.word = c.word""",
    "V5_rollup_index": f"WITH {_LONG}, lv AS (SELECT unnest(range(0, ceil(log2(floor(max(idx) / 32.0) + 1))::BIGINT + 1)) AS level FROM p) SELECT level, idx // 32 // (1 << level::INT) AS node, coalesce(min(value) FILTER (NOT bad), 'inf'::DOUBLE) AS y_min, coalesce(max(value) FILTER (NOT bad), '-inf'::DOUBLE) AS y_max, round(coalesce(sum(value) FILTER (NOT bad), 0), 4) AS y_sum FROM p, lv GROUP BY 1, 2",
    "V6_summarize_range": f"WITH {_LONG}, q AS (SELECT 1 AS series_no, idx, value FROM p WHERE NOT bad UNION ALL SELECT 2, idx, -value FROM p WHERE NOT bad) SELECT series_no, min(value) AS y_min, max(value) AS y_max, round(sum(value), 4) AS y_sum FROM q WHERE idx >= 37 AND idx < 7013 GROUP BY series_no",
    "V7_is_sorted_series": f"WITH {_E}, t AS (SELECT user_id, event_id, us - CASE WHEN event_id % 131 = 0 THEN {HOUR} ELSE 0 END AS x FROM e), g AS (SELECT user_id, x - lag(x) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM t) SELECT user_id, bool_and(coalesce(d >= 0, true)) AS sorted FROM g GROUP BY user_id",
    "K1_csv_rows": f"""{_CELLS}, g AS (SELECT ms, i FROM (SELECT DISTINCT ms FROM c), k),
        r AS (SELECT ms, string_agg(coalesce(printf('%.6f', v), ''), ',' ORDER BY i) AS cells FROM g LEFT JOIN c USING (ms, i) GROUP BY ms)
        SELECT ms, printf('%03d:%02d:%02d:%02d.%03d,', 1 + ms // 86400000, ms % 86400000 // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) || cells AS line FROM r""",
    "S9_csv_round_trip": f"""{_CELLS}
        SELECT CASE WHEN i < 2 THEN 'lock' ELSE 'level' END AS metric, CASE WHEN i < 2 THEN kind ELSE i || ' - L_' || kind || ' C_RCVR' || i END AS name, i % 2 AS source_id,
        CASE WHEN i < 2 THEN 0 ELSE i END AS receiver, 0 AS channel, round((ms - (SELECT min(ms) FROM c)) / 1000.0::DOUBLE, 3) AS elapsed, v AS value FROM c JOIN k USING (i)""",
    "K3_write_per_source": f"WITH {_S} SELECT source_id, count(*) AS points, round(sum(value), 4) AS total FROM s GROUP BY source_id",
    "K4_write_samples": f"WITH {_S} SELECT source_id, metric, count(*) AS points, round(max(t_abs), 6) AS last FROM s GROUP BY source_id, metric",
}
ORACLES["S9_utf16_round_trip"] = ORACLES["S9_csv_round_trip"]
