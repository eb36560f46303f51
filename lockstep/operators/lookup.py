"""Looking at long series: nearest samples, as-of joins, envelopes and rollup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lockstep.operators.scans import Carry, cut_at, ordered_scan, quantile_bounds
from lockstep.operators.series import slice_with_neighbours
from lockstep.session import materialize

MAX_SAMPLES_PER_COLUMN = 2
BLOCK = 32
#: A slab is the part of the view index below one node of this level: a million samples.
SLAB_LEVEL = 15


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], values: list[str], chunk: Column | None = None,
                  fallback_first: bool = False, rows_per_chunk: int | None = None) -> DataFrame:
    """Each left row with the latest right row at or before it (right first at equal ``order``), by one ordered scan.

    ``order`` columns exist on both sides. The scan is cut by ``chunk``, or into quantiles of the first order column of both sides. With ``fallback_first`` rows before any right row take the first one.
    """
    marks = right.select(*keys, *order, F.struct(*values).alias("_right"), F.lit(0).alias("_side"))
    rows = left.withColumns({"_side": F.lit(1), "_row": F.struct(*[c for c in left.columns if c not in (*keys, *order)])})
    both = marks.unionByName(rows.select(*keys, *order, "_side", "_row"), allowMissingColumns=True)
    if rows_per_chunk:
        both, chunk = cut_at(both, order[0], quantile_bounds(left.select(order[0]).unionByName(right.select(order[0])), order[0], rows_per_chunk))
    found = ordered_scan(both, keys, [*order, "_side"], [Carry("_found", F.col("_right"), "last")], chunk).where("_side = 1")
    if fallback_first:
        first = right.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
        found = (found.join(first, keys, "left") if keys else found.join(first, F.lit(True), "left")).withColumn("_found", F.coalesce("_found", "_first"))
    return found.select(*keys, *order, "_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def nearest_sample(points: DataFrame, probes: DataFrame, rows_per_chunk: int | None = 250_000, max_dist: float | None = None, series: str = "series_no",
                   x: str = "x", pinned: bool = False) -> DataFrame:
    """The sample nearest in time to every probe (``probe_id, x``), over all series or, if ``pinned``, in the probe's own.

    Points: ``series_no, idx, x, value``. At equal distance the first series wins, and within a series the sample at or after
    the probe. The time axis is cut into quantiles of both sides' times. One ordered scan gives both neighbours; probes and points are never paired.
    """
    keys = [series] if pinned else []
    side = points.select(F.col(x).cast("double").alias("x"), F.lit(0).alias("_kind"), F.struct(
        F.col(x).cast("double").alias("x"), F.col(series).alias("s"), F.col("idx").alias("i"), F.col("value").alias("v")).alias("_point"),
        *([F.col(series)] if pinned else []))
    asks = probes.select(F.col(x).cast("double").alias("x"), F.lit(1).alias("_kind"), "probe_id", *([F.col(series)] if pinned else []))
    # Equal times are one place: before a probe its first series (and that one's last sample) counts, after it the first of the first.
    before = (side.groupBy(*keys, "x").agg(F.max_by("_point", F.struct(-F.col("_point.s"), F.col("_point.i"))).alias("_before"),
                                           F.min_by("_point", F.struct("_point.s", "_point.i")).alias("_after")))
    both = before.withColumn("_kind", F.lit(1)).unionByName(asks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    cut = None
    if rows_per_chunk:
        times = points.select(F.col(x).cast("double").alias("x")).unionByName(probes.select(F.col(x).cast("double").alias("x")))
        both, cut = cut_at(both, "x", quantile_bounds(times, "x", rows_per_chunk))
    # A probe sorts before points of its own time, so those count as at or after it.
    found = ordered_scan(both, keys, ["x", "_kind"], [Carry("_lo", F.col("_before"), "last"), Carry("_hi", F.col("_after"), "next")], cut)
    found = found.where("_kind = 0")
    lo, hi = F.col("_lo"), F.col("_hi")
    d_lo, d_hi = F.abs(lo.x - F.col("x")), F.abs(hi.x - F.col("x"))
    take_hi = lo.isNull() | (d_hi < d_lo) | ((d_hi == d_lo) & (hi.s <= lo.s))
    best = F.when(hi.isNotNull() & take_hi, hi).otherwise(lo)
    out = found.withColumn("_best", best).where("_best is not null").select(
        "probe_id", "x", F.col("_best.s").alias(series), F.col("_best.i").alias("idx"), F.col("_best.x").alias("nearest_x"),
        F.col("_best.v").alias("value"), F.abs(F.col("_best.x") - F.col("x")).alias("distance"))
    return out if max_dist is None else out.where(F.col("distance") <= max_dist)


def in_view(points: DataFrame, keys: list[str], lo: float, hi: float, x: str = "x", idx: str = "idx") -> DataFrame:
    """The samples of ``[lo, hi]`` and one on each side of it, which a line to the view's edges needs."""
    return slice_with_neighbours(points, keys, [x, idx], lo, hi, x)


def _columns(seen: DataFrame, lo: float, hi: float, columns: int, x: str) -> Column:
    """The time column of a sample: the last moment belongs to the last one; the neighbours outside get -1 and ``columns``."""
    inside = F.least(F.floor((F.col(x) - lo) / (hi - lo) * columns), F.lit(columns - 1))
    return F.when(F.col(x) < lo, -1).when(F.col(x) > hi, columns).otherwise(inside).cast("long")


def _counted(seen: DataFrame, keys: list[str]) -> DataFrame:
    return seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def envelope(points: DataFrame, keys: list[str], lo: float, hi: float, columns: int, x: str = "x", value: str = "value",
             idx: str = "idx", chunk: Column | None = None) -> DataFrame:
    """Minimum, maximum and mean per time column of sorted series, for series with more than two samples in view per column.

    A value that is not finite breaks the line: samples on its two sides never share a row (``run`` tells them apart).
    """
    seen = in_view(points, keys, lo, hi, x, idx)
    bad = _not_finite(F.col(x)) | _not_finite(F.col(value))
    flagged = seen.withColumn("_bad", bad.cast("int"))
    runs = ordered_scan(flagged, keys, [idx], [Carry("run", F.col("_bad"), "sum")], chunk if chunk is not None else F.expr(f"{idx} div 1048576"))
    dense = _counted(seen, keys).where(F.col("_n") > columns * MAX_SAMPLES_PER_COLUMN)
    return (runs.where("_bad = 0").join(dense.select(*keys), keys, "left_semi").withColumn("column", _columns(seen, lo, hi, columns, x))
            .groupBy(*keys, "run", "column").agg(F.min_by(x, idx).alias("x"), F.min(value).alias("y_min"), F.max(value).alias("y_max"),
                                                 F.avg(value).alias("y_mean"), F.count(F.lit(1)).alias("n")))


def envelope_or_raw(points: DataFrame, keys: list[str], lo: float, hi: float, columns: int, x: str = "x", value: str = "value",
                    idx: str = "idx", chunk: Column | None = None) -> DataFrame:
    """``envelope`` where a series is dense in view, its finite samples in view as they are elsewhere (``decimated`` says which)."""
    dense = envelope(points, keys, lo, hi, columns, x, value, idx, chunk).withColumn("decimated", F.lit(True))
    seen = in_view(points, keys, lo, hi, x, idx)
    few = _counted(seen, keys).where(F.col("_n") <= columns * MAX_SAMPLES_PER_COLUMN)
    raw = _raw(seen.join(few.select(*keys), keys, "left_semi"), keys, x, value)
    return dense.unionByName(raw, allowMissingColumns=True)


def _raw(seen: DataFrame, keys: list[str], x: str, value: str) -> DataFrame:
    return seen.where(~_not_finite(F.col(x)) & ~_not_finite(F.col(value))).select(
        *keys, F.col(x).alias("x"), F.col(value).alias("y_min"), F.col(value).alias("y_max"), F.col(value).alias("y_mean"),
        F.lit(1).cast("long").alias("n"), F.lit(False).alias("decimated"))


def _not_finite(c: Column) -> Column:
    return F.isnan(c) | c.isin(float("inf"), float("-inf"))


def rollup_index(points: DataFrame, keys: list[str], idx: str = "idx", value: str = "value", block: int = BLOCK) -> DataFrame:
    """Minimum, maximum and sum pyramid: ``level`` 0 holds blocks of ``block`` samples, each level above pairs the one below.

    Leaves are aggregated first; each then counts towards its few ancestors, so the samples are read and shuffled once.
    """
    finite = ~_not_finite(F.col(value))
    kept = F.when(finite, F.col(value))
    leaves = points.groupBy(*keys, F.expr(f"{idx} div {block}").alias("node")).agg(
        F.coalesce(F.min(kept), F.lit(float("inf"))).alias("y_min"), F.coalesce(F.max(kept), F.lit(float("-inf"))).alias("y_max"),
        F.coalesce(F.sum(kept), F.lit(0.0)).alias("y_sum"))
    tops = points.groupBy(*keys).agg((F.floor(F.max(idx) / block) + 1).alias("_leaves"))
    height = F.ceil(F.round(F.log2("_leaves"), 9)).cast("int")
    spread = leaves.join(tops, keys).withColumn("level", F.explode(F.sequence(F.lit(0), height)))
    up = spread.withColumn("node", F.expr("shiftright(node, level)"))
    return up.groupBy(*keys, "level", "node").agg(F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), F.sum("y_sum").alias("y_sum"))


def summarize_range(points: DataFrame, index: DataFrame, keys: list[str], first: int, last: int, idx: str = "idx", value: str = "value",
                    block: int = BLOCK) -> DataFrame:
    """Minimum, maximum and sum of the finite samples ``[first, last)`` from the rollup index and the samples of cut blocks.

    Of the index the largest nodes inside the range count: those whose parent is not inside (or that have none). A sample counts by
    itself if its block is not inside. Both are filters on ``level, node`` and on the sample number, which scans prune by.
    """
    def inside(level: Column, node: Column) -> Column:
        width = F.lit(block) * F.call_function("shiftleft", F.lit(1).cast("long"), level)
        return (node * width >= first) & ((node + 1) * width <= last)

    leaf = F.expr(f"{idx} div {block}")
    kept = F.when(~_not_finite(F.col(value)), F.col(value))
    cut = points.where((F.col(idx) >= first) & (F.col(idx) < last) & ~inside(F.lit(0), leaf))
    singles = cut.select(*keys, kept.alias("y_min"), kept.alias("y_max"), kept.alias("y_sum"))
    tops = index.groupBy(*keys).agg(F.max("level").alias("_top"))
    whole = index.where(inside(F.col("level"), F.col("node"))).join(tops, keys)
    parent = inside(F.col("level") + 1, F.expr("shiftright(node, 1)"))
    nodes = whole.where((F.col("level") == F.col("_top")) | ~parent).select(*keys, "y_min", "y_max", "y_sum")
    both = singles.unionByName(nodes).groupBy(*keys).agg(F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), F.sum("y_sum").alias("y_sum"))
    some = both.y_min <= both.y_max  # blocks without a finite sample hold an empty range
    return both.select(*keys, F.when(some, F.col("y_min")).alias("y_min"), F.when(some, F.col("y_max")).alias("y_max"), F.when(some, F.col("y_sum")).alias("y_sum"))


def view_index(points: DataFrame, keys: list[str], x: str = "x", value: str = "value", idx: str = "idx", block: int = BLOCK,
               slab_level: int = SLAB_LEVEL) -> DataFrame:
    """The pyramid that `indexed_envelope` reads: per node the first and last time, the finite samples' ``y_min, y_max, y_sum`` and
    ``n``, and ``bad``, the samples that are not finite.

    Nodes below ``slab_level`` carry their ``slab`` (the node of that level above them), all others -1, so a reader can leave out the slabs
    it does not need. ``up_first, up_last, up_bad`` are those of the parent (a root has ``up_bad`` 1): whether a node is the largest that
    fits is told by its row alone. Samples are read and shuffled once; only a slab's sums count towards the levels above it.
    """
    good = ~_not_finite(F.col(x)) & ~_not_finite(F.col(value))
    kept = F.when(good, F.col(value))
    leaves = points.groupBy(*keys, F.expr(f"{idx} div {block}").alias("leaf")).agg(
        F.min(x).alias("x_first"), F.max(x).alias("x_last"), F.min(kept).alias("y_min"), F.max(kept).alias("y_max"),
        F.sum(kept).alias("y_sum"), F.count(kept).alias("n"), F.count_if(~good).alias("bad"))
    leaves = materialize(leaves)

    def summed(rows: DataFrame, levels: Column) -> DataFrame:
        spread = rows.withColumn("level", F.explode(levels)).withColumn("node", F.expr("shiftright(leaf, level)"))
        return spread.groupBy(*keys, "level", "node").agg(
            F.min("x_first").alias("x_first"), F.max("x_last").alias("x_last"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
            F.sum("y_sum").alias("y_sum"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    below = summed(leaves, F.sequence(F.lit(0), F.lit(slab_level - 1)))
    slabs = summed(leaves, F.array(F.lit(slab_level))).withColumn("leaf", F.expr(f"shiftleft(node, {slab_level})"))
    last = slabs.groupBy(*keys).agg(F.max("node").alias("_last"))
    height = slab_level + F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda h: F.call_function("shiftright", F.col("_last"), h) > 0))
    tops = slabs.join(last.withColumn("_height", height), keys)
    above = summed(tops.drop("level", "node"), F.sequence(F.lit(slab_level), F.col("_height")))
    nodes = below.unionByName(above).join(last.withColumn("_height", height).drop("_last"), keys)
    pair = W.partitionBy(*keys, "level", F.expr("shiftright(node, 1)"))  # a node and its sibling
    return nodes.select(
        *keys, F.when(F.col("level") < slab_level, F.expr(f"shiftright(node, {slab_level} - level)")).otherwise(-1).alias("slab"),
        "level", "node", "x_first", "x_last", "y_min", "y_max", "y_sum", "n", "bad", F.min("x_first").over(pair).alias("up_first"),
        F.max("x_last").over(pair).alias("up_last"),
        F.when(F.col("level") == F.col("_height"), 1).otherwise(F.sum("bad").over(pair)).cast("long").alias("up_bad"))


def write_view_index(index: DataFrame, path: str) -> None:
    """Store a `view_index` with a folder per slab (-1: all nodes above slabs), sorted inside by level and node."""
    index.repartition("slab").sortWithinPartitions("slab", "level", "node").write.mode("overwrite").partitionBy("slab").parquet(path)


def read_view_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("slab", F.col("slab").cast("long"))


def indexed_envelope(points: DataFrame, index: DataFrame, keys: list[str], lo: float, hi: float, columns: int, x: str = "x",
                     value: str = "value", idx: str = "idx", block: int = BLOCK, slab_level: int = SLAB_LEVEL, slab: str | None = None) -> DataFrame:
    """`envelope_or_raw` of sorted series, from a stored `view_index` and the samples of the blocks that a column border cuts.

    A node whose samples are all finite and lie in one time column stands for them; of such nodes the largest are taken. The nodes above
    slabs come first; only slabs that a border, a view end or a value that is not finite cuts are opened, and of those only the cut
    blocks' samples are fetched. If the samples are stored by slab, ``slab`` names that column, and scans of both tables skip all others.
    The series' order must agree with its times; `is_sorted_series` tells.
    """
    def column(name: str) -> Column:
        return _columns(index, lo, hi, columns, name)

    def fits(first: str, last: str, bad: str) -> Column:
        return (F.col(bad) == 0) & (column(first) == column(last)) & column(first).between(0, columns - 1)

    outside = (F.col("x_last") < lo) | (F.col("x_first") > hi)

    def cut(nodes: DataFrame) -> DataFrame:
        """Nodes to be opened: neither whole nor out of view, and those that hold the neighbours of the view."""
        ends = nodes.groupBy(*keys).agg(F.max(F.when(F.col("x_first") < lo, F.col("node"))).alias("_before"),
                                        F.min(F.when(~(F.col("x_last") <= hi), F.col("node"))).alias("_after"))
        open_ = ~outside & ~fits("x_first", "x_last", "bad")
        return nodes.join(ends, keys).where(open_ | F.coalesce(F.col("node") == F.col("_before"), F.lit(False))
                                            | F.coalesce(F.col("node") == F.col("_after"), F.lit(False))).select(*keys, "node")

    upper = index.where("slab = -1")
    slabs = materialize(cut(upper.where(F.col("level") == slab_level)).withColumnRenamed("node", "slab"))
    lower = index.where("slab >= 0").join(slabs, [*keys, "slab"], "left_semi")
    blocks = materialize(cut(lower.where("level = 0")).withColumn("slab", F.expr(f"shiftright(node, {slab_level})")))
    largest = fits("x_first", "x_last", "bad") & ~fits("up_first", "up_last", "up_bad")
    whole = upper.unionByName(lower.select(*upper.columns)).where(largest).select(
        *keys, (F.expr("shiftleft(node, level)") * block).alias("idx"), F.col("x_first").alias("x"), column("x_first").alias("column"), "y_min", "y_max", "y_sum",
        "n", F.lit(0).alias("_bad"), F.col("n").alias("_all"))
    at = points.withColumn("node", F.expr(f"{idx} div {block}"))
    if slab is not None:
        fetched = at.withColumnRenamed(slab, "slab").join(slabs, [*keys, "slab"], "left_semi").join(blocks.drop("slab"), [*keys, "node"], "left_semi")
    else:
        fetched = at.join(blocks, [*keys, "node"], "left_semi")
    singles = materialize(fetched.select(*keys, F.col(idx).alias("idx"), F.col(x).alias("x"), F.col(value).alias("y_min")))
    seen = slice_with_neighbours(singles, keys, ["x", "idx"], lo, hi, "x")
    broken = _not_finite(F.col("x")) | _not_finite(F.col("y_min"))
    single = seen.select(*keys, "idx", "x", _columns(seen, lo, hi, columns, "x").alias("column"), "y_min", F.col("y_min").alias("y_max"),
                         F.col("y_min").alias("y_sum"), F.lit(1).cast("long").alias("n"), broken.cast("int").alias("_bad"), F.lit(1).cast("long").alias("_all"))
    drawn = whole.unionByName(single)
    counts = drawn.groupBy(*keys).agg(F.sum("_all").alias("_n"))
    dense = counts.where(F.col("_n") > columns * MAX_SAMPLES_PER_COLUMN).select(*keys)
    runs = ordered_scan(drawn.join(dense, keys, "left_semi"), keys, ["idx"], [Carry("run", F.col("_bad"), "sum")], F.expr("idx div 1048576"))
    bands = runs.where("_bad = 0").groupBy(*keys, "run", "column").agg(
        F.min_by("x", "idx").alias("x"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"), (F.sum("y_sum") / F.sum("n")).alias("y_mean"),
        F.sum("n").alias("n")).withColumn("decimated", F.lit(True))
    few = counts.where(F.col("_n") <= columns * MAX_SAMPLES_PER_COLUMN).select(*keys)
    return bands.unionByName(_raw(in_view(points.join(few, keys, "left_semi"), keys, lo, hi, x, idx), keys, x, value), allowMissingColumns=True)


def is_sorted_series(points: DataFrame, keys: list[str], order: list[str], x: str = "x", chunk: Column | None = None) -> DataFrame:
    """Whether every time after a series' first is finite and not before its predecessor."""
    near = ordered_scan(points, keys, order, [Carry("_prev", F.col(x), "last", inclusive=False)], chunk)
    fine = F.col("_prev").isNull() | (~_not_finite(F.col(x)) & (F.isnan("_prev") | (F.col(x) >= F.col("_prev"))))
    return near.groupBy(*keys).agg(F.bool_and(fine).alias("sorted"))
