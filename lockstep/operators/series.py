"""Series on a shared time axis: building, combining recordings, identity, ranges and views.

The long form is ``metric, name, stream_label, receiver, channel, stream_order, stream_seq, source_id, elapsed, value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lockstep.functions import text
from lockstep.functions.text import LEVEL, LOCK, MISSED
from lockstep.operators.scans import Carry, ordered_scan

SERIES = ["source_id", "stream_seq", "metric", "ord", "name", "stream_label", "receiver", "channel", "stream_order"]
STREAM = ["source_id", "stream_label", "channel_id"]


def build_series(samples: DataFrame, channel_samples: DataFrame, streams: DataFrame) -> DataFrame:
    """Long series points of every stream: lock and missed for lock streams, one series per channel for receiver streams.

    ``streams``: ``stream_id, source_id, channel_id, label, mode, job_index``. ``ord`` keeps the configured order of channels.
    """
    ident = streams.select("stream_id", "source_id", F.col("channel_id").alias("stream_order"), F.col("job_index").alias("stream_seq"),
                           text.stream_label_column(F.col("label"), F.col("channel_id")).alias("stream_label"), "mode")
    lock = (samples.join(ident.where("mode = 'lock'"), "stream_id").select(
        *_identity(), F.col("stream_label").alias("name"), F.lit(0).alias("receiver"), F.lit(0).alias("channel"), F.lit(0).alias("ord"), "t_abs",
        F.explode(F.array(F.struct(F.lit(LOCK).alias("metric"), F.col("lock_pct").alias("value")),
                          F.struct(F.lit(MISSED).alias("metric"), F.col("missed").cast("double").alias("value")))).alias("m"))
        .select("*", "m.metric", "m.value").drop("m"))
    names = channel_index(channel_samples.select("stream_id", "ord", "name").distinct().withColumn(
        "receiver", text.receiver_number(F.col("name"))), ["stream_id", "receiver"], "ord")
    level = (channel_samples.join(names.drop("name"), ["stream_id", "ord"]).join(ident.where("mode = 'receiver'"), "stream_id").select(
        *_identity(), text.level_series_name(F.col("stream_order"), F.col("stream_label"), F.col("name")).alias("name"), "receiver", "channel",
        "ord", "t_abs", F.lit(LEVEL).alias("metric"), "value"))
    return lock.unionByName(level)


def _identity() -> list[str]:
    return ["source_id", "stream_seq", "stream_label", "stream_order"]


def channel_index(columns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Running count within ``keys`` in column order, from 0. One row per series, so a key is small."""
    return columns.withColumn("channel", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)


def series_range(points: DataFrame, keys: list[str], order: str, value: str = "value", chunk: Column | None = None) -> DataFrame:
    """Smallest and largest value per series, with the ranges' two ways with a NaN.

    The largest never becomes NaN. The smallest takes a NaN and then forgets what came before it: it is the least of the values
    after the last NaN, and NaN itself if the series ends on one. Empty ranges are inf and -inf.
    """
    last_nan = points.groupBy(*keys).agg(F.max(F.when(F.isnan(value), F.col(order))).alias("_last_nan"))
    kept = points.join(last_nan, keys)
    finite = ~F.isnan(value)
    after = F.col("_last_nan").isNull() | (F.col(order) > F.col("_last_nan"))
    out = kept.groupBy(*keys).agg(F.min(F.when(finite & after, F.col(value))).alias("_min"), F.max(F.when(finite, F.col(value))).alias("_max"),
                                  F.max("_last_nan").alias("_last_nan"))
    empty = F.when(F.col("_last_nan").isNotNull(), F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return out.select(*keys, F.coalesce("_min", empty).alias("y_min"), F.coalesce("_max", F.lit(float("-inf"))).alias("y_max"))


def replace_streams(old: DataFrame, new: DataFrame, identity: list[str] | None = None) -> DataFrame:
    """New streams replace old ones of the same identity; the rest stay."""
    identity = identity or STREAM
    return old.join(new.select(*identity).distinct(), identity, "left_anti").unionByName(new)


def time_base(samples: DataFrame, time: str = "t_abs") -> DataFrame:
    """One row: the earliest time over all sources, its day of year and seconds after midnight (UTC)."""
    base = samples.agg(F.min(time).alias("base_s"))
    whole = F.timestamp_seconds(F.floor("base_s"))
    return base.select("base_s", F.dayofyear(whole).alias("base_day"), (F.col("base_s") - F.floor(F.col("base_s") / 86400) * 86400).alias("base_offset"))


def align_elapsed(samples: DataFrame, time: str = "t_abs") -> DataFrame:
    """``elapsed`` seconds from the earliest sample of any source. Adding or removing sources re-bases by running it again."""
    return samples.join(time_base(samples, time).select("base_s"), F.lit(True)).withColumn("elapsed", F.col(time) - F.col("base_s")).drop("base_s")


def source_spans(samples: DataFrame, source: str = "source_id", time: str = "t_abs") -> DataFrame:
    return samples.groupBy(source).agg(F.min(time).alias("first"), F.max(time).alias("last"))


def source_overlap(spans: DataFrame, added: DataFrame, source: str = "source_id") -> DataFrame:
    """For every added source, how many of the others it overlaps (closed intervals touch at an end).

    Counted, not listed: a source misses those that end before it starts and those that start after it ends, and both are ranks
    among all ends and starts, so no pairs are formed. A source does not count itself.
    """
    probe = added.select(F.col(source).alias("_id"), "first", "last")
    known = spans.select(F.col(source).alias("_id"), "first", "last")
    # Ends strictly before a start: ends sort after equal starts. Starts strictly after an end: starts sort before equal ends.
    ended = known.select(F.col("last").alias("at"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(None).cast(spans.schema[source].dataType).alias("_id"))
    asks = probe.select(F.col("first").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), "_id")
    before = _rank(ended.unionByName(asks)).where("kind = 0").select("_id", F.col("_upto").alias("before"))
    started = known.select(F.col("first").alias("at"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(None).cast(spans.schema[source].dataType).alias("_id"))
    tells = probe.select(F.col("last").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), "_id")
    begun = _rank(started.unionByName(tells)).where("kind = 1").select("_id", F.col("_upto").alias("begun"))
    itself = probe.join(known.select("_id").withColumn("_self", F.lit(1)), "_id", "left")
    count = F.col("begun") - F.col("before") - F.coalesce("_self", F.lit(0))
    return (itself.join(before, "_id").join(begun, "_id")
            .select(F.col("_id").alias(source), count.alias("overlaps"), (count > 0).alias("overlapping")))


def _rank(marks: DataFrame) -> DataFrame:
    cut = F.floor(F.col("at").cast("double") / 86400).cast("long")
    return ordered_scan(marks, [], ["at", "kind"], [Carry("_upto", F.col("n"), "sum")], cut)


def assign_stream_orders(series: DataFrame, position: str = "position") -> DataFrame:
    """Stream ids for imported lock and missed series: the id of the level series with the same source and label, else new ids
    above every id in use, in the order first met. One row per series."""
    known = (series.where((F.col("metric") == LEVEL) & (F.col("stream_label") != "")).groupBy("source_id", "stream_label")
             .agg(F.max_by("stream_order", position).alias("_known")))
    top = series.agg(F.greatest(F.lit(0), F.max(F.col("stream_order") + 1)).alias("_next"))
    fresh = (series.where(F.col("metric") != LEVEL).groupBy("source_id", "stream_label").agg(F.min(position).alias("_first"))
             .join(known, ["source_id", "stream_label"], "left_anti"))
    ranked = ordered_scan(fresh, [], ["_first"], [Carry("_rank", F.lit(1), "count", inclusive=False)], F.expr("_first div 1048576"))
    fresh = ranked.join(top, F.lit(True)).select("source_id", "stream_label", (F.col("_next") + F.col("_rank")).alias("_fresh"))
    joined = series.join(known, ["source_id", "stream_label"], "left").join(fresh, ["source_id", "stream_label"], "left")
    return joined.withColumn("stream_order", F.when(F.col("metric") == LEVEL, F.col("stream_order"))
                             .otherwise(F.coalesce("_known", "_fresh")).cast("int")).drop("_known", "_fresh")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Many recordings overlaid as one long table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def source_list(points: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Each source once with its label, else "Source N"."""
    ids = points.select("source_id").distinct()
    if labels is not None:
        ids = ids.join(labels.select("source_id", "label"), "source_id", "left")
    else:
        ids = ids.withColumn("label", F.lit(None).cast("string"))
    return ids.withColumn("label", F.coalesce("label", F.concat(F.lit("Source "), F.col("source_id").cast("string"))))


# --- views ----------------------------------------------------------------------------------------------------------------

def filter_view(points: DataFrame, view: str = LOCK, source: int | None = None) -> DataFrame:
    """What a view shows: of lock and missed only the one in view, levels always; one source or all."""
    shown = points.where(F.col("metric").isin(view, LEVEL))
    return shown if source is None else shown.where(F.col("source_id") == source)


def slice_time(points: DataFrame, start: float, stop: float, x: str = "elapsed") -> DataFrame:
    """Points within a typed window: both ends are clamped to 0 .. the last time, and a stop before the start is pulled up to it."""
    limits = slice_limits(points, start, stop, x).select("start", "stop")
    return points.join(limits, F.lit(True)).where(F.col(x).between(F.col("start"), F.col("stop"))).drop("start", "stop")


def slice_limits(points: DataFrame, start: float, stop: float, x: str = "elapsed") -> DataFrame:
    """One row: the window used, and what had to be changed (``start_clamped, stop_clamped, stop_before_start``)."""
    end = points.agg(F.coalesce(F.max(x), F.lit(0.0)).cast("double").alias("x_max"))

    def clamp(v: float) -> Column:
        return F.least(F.col("x_max"), F.greatest(F.lit(0.0), F.lit(float(v))))

    near = 1e-12
    return end.select(
        "x_max", clamp(start).alias("start"), F.greatest(clamp(start), clamp(stop)).alias("stop"),
        (F.abs(clamp(start) - start) > near * F.greatest(F.lit(1.0), F.abs(F.lit(float(start))))).alias("start_clamped"),
        (F.abs(clamp(stop) - stop) > near * F.greatest(F.lit(1.0), F.abs(F.lit(float(stop))))).alias("stop_clamped"),
        (clamp(start) > clamp(stop)).alias("stop_before_start"))


def slice_with_neighbours(points: DataFrame, keys: list[str], order: list[str], lo: float, hi: float, x: str = "elapsed",
                          chunk: Column | None = None) -> DataFrame:
    """Samples of sorted series in view plus one on each side.

    Only the nearest sample outside each end can join, so those are picked by aggregation; nothing is sorted.
    """
    inside = points.where(F.col(x).between(lo, hi))
    before = points.where(F.col(x) < lo).groupBy(*keys).agg(F.max(F.struct(*order)).alias("_at"))
    after = points.where(F.col(x) > hi).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_at"))
    ends = before.unionByName(after).select(*keys, "_at.*")
    outside = points.where((F.col(x) < lo) | (F.col(x) > hi)).join(ends, [*keys, *order], "left_semi")
    return inside.unionByName(outside.select(*points.columns))


# --- templates ------------------------------------------------------------------------------------------------------------

def match_template(template_ids: DataFrame, files: DataFrame, file_key: str = "source_id", template: str | None = None) -> DataFrame:
    """Every file's channel ids against those of its template: ``missing`` and ``extra`` (ascending), ``ok`` if neither.

    ``template_ids``: ``template, channel_id``; ``files``: ``file_key, channel_id`` and ``template``, the name of the one it is held
    against (or one ``template`` for all). An equi-join by name; a file's id set is small (its channels).
    """
    wanted = template_ids.groupBy("template").agg(F.array_sort(F.collect_set("channel_id")).alias("wanted"))
    named = files.withColumn("template", F.lit(template)) if template is not None else files
    present = named.groupBy(file_key, "template").agg(F.array_sort(F.collect_set("channel_id")).alias("present"))
    both = present.join(wanted, "template")
    return both.select(file_key, "template", F.array_sort(F.array_except("wanted", "present")).alias("missing"),
                       F.array_sort(F.array_except("present", "wanted")).alias("extra")).withColumn(
        "ok", (F.size("missing") == 0) & (F.size("extra") == 0))


def describe_match(missing: Column, extra: Column) -> Column:
    """A mismatch as ``missing=.. extra=..``; empty when there is none."""
    def part(label: str, ids: Column) -> Column:
        return F.when(F.size(ids) > 0, F.concat(F.lit(label), F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")))

    return F.concat_ws(" ", part("missing=", missing), part("extra=", extra))


def apply_template(recordings: DataFrame, channels: DataFrame, entries: DataFrame, time_channel_index: int = -1,
                   template: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Streams to run over every recording that matches exactly, in one job, and the recordings skipped with the reason.

    ``recordings``: ``source_id, path``; ``channels``: the catalog; ``entries``: ``template, channel_id, process, ...``. The time channel is
    the one at the template's place in the recording's list, else the recording's first.
    """
    files = channels.where("type = 'PCMIN'").select("source_id", "channel_id", *([] if template is not None else ["template"]))
    matched = match_template(entries.select("template", "channel_id"), files, template=template)
    checked = recordings.join(matched, "source_id", "left")
    reason = F.when(F.col("ok").isNull(), "no_channels").otherwise(describe_match(F.col("missing"), F.col("extra")))
    skipped = checked.where(~F.coalesce("ok", F.lit(False))).select("source_id", "template", reason.alias("reason"))
    times = channels.where("type = 'TIMEIN'").groupBy("source_id").agg(F.array_sort(F.collect_list("channel_id")).alias("_times"))
    pick = F.coalesce(F.try_element_at("_times", F.lit(time_channel_index + 1 if time_channel_index >= 0 else 1)), F.try_element_at("_times", F.lit(1)))
    ready = (checked.where("ok").select("source_id", "path", "template").join(times, "source_id", "left")
             .withColumn("time_channel_id", F.coalesce(pick, F.lit(-1))).drop("_times"))
    runs = ready.join(entries.where("process").drop("process"), "template")
    return runs.withColumn("stream_id", F.concat_ws("/", F.col("source_id").cast("string"), F.col("channel_id").cast("string"))), skipped
