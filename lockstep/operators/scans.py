"""Ordered scans that split a hot key.

A window function runs one key in one task. Here a key's rows are cut into order-preserving *chunks*; each chunk is scanned
on its own and the chunks' totals - one small row each - are scanned once more to carry values across chunk borders. The wide
shuffle is by (key, chunk), so a key that holds a third of all rows still spreads over the cluster, and the summaries are
pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "_chunk"


@dataclass(frozen=True)
class Carry:
    """One column to add: ``how`` is sum, count, max, min, last (latest non-null before), next (earliest non-null after).

    ``inclusive`` says whether the row itself takes part.
    """

    name: str
    value: Column
    how: str
    inclusive: bool = True


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], carries: list[Carry],
                 chunk: Column | None = None) -> DataFrame:
    """Add running values to ``df`` per ``keys`` in ``order``.

    ``chunk`` must not decrease as ``order`` increases within a key, and must bound the rows of one (key, chunk).
    Without it each key is scanned in one task: only for keys whose size is bounded by what they are.
    """
    if chunk is None:
        return _scan_within(df, keys, order, carries)
    staged = df.withColumn(CHUNK, chunk)
    values = {f"_v{i}": c for i, c in enumerate(carries)}
    staged = staged.select("*", *[c.value.alias(v) for v, c in values.items()])
    position = F.struct(*order)
    summary = staged.groupBy(*keys, CHUNK).agg(*[_summarise(c, F.col(v), position).alias(f"_s{v}")
                                                 for v, c in values.items()])
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(*keys, CHUNK, *[_carry(c, F.col(f"_s{v}"), before, after).alias(f"_c{v}")
                                           for v, c in values.items()])
    local = _scan_within(staged, [*keys, CHUNK], order,
                         [Carry(f"_l{v}", F.col(v), c.how, c.inclusive) for v, c in values.items()])
    joined = local.join(carry, [*keys, CHUNK], "left")
    out = [_combine(c, F.col(f"_l{v}"), F.col(f"_c{v}")).alias(c.name) for v, c in values.items()]
    return joined.select(*df.columns, *out)


def _scan_within(df: DataFrame, keys: list[str], order: list[str], carries: list[Carry]) -> DataFrame:
    base = W.partitionBy(*keys).orderBy(*order)
    cols = []
    for c in carries:
        if c.how == "next":
            # Looking ahead is looking back in reverse order: a frame that only grows is filled in one pass.
            back = W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
            frame = back.rowsBetween(W.unboundedPreceding, 0 if c.inclusive else -1)
            cols.append(F.last(c.value, ignorenulls=True).over(frame).alias(c.name))
            continue
        frame = base.rowsBetween(W.unboundedPreceding, 0 if c.inclusive else -1)
        if c.how == "last":
            expr = F.last(c.value, ignorenulls=True).over(frame)
        elif c.how in ("sum", "count"):
            total = F.sum(c.value) if c.how == "sum" else F.count(c.value)
            expr = F.coalesce(total.over(frame), F.lit(0))
        else:
            expr = (F.max(c.value) if c.how == "max" else F.min(c.value)).over(frame)
        cols.append(expr.alias(c.name))
    return df.select("*", *cols)


def _summarise(c: Carry, value: Column, position: Column) -> Column:
    if c.how in ("last", "next"):
        place = F.when(value.isNotNull(), position)
        return F.max_by(value, place) if c.how == "last" else F.min_by(value, place)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[c.how](value)


def _carry(c: Carry, value: Column, before, after) -> Column:
    if c.how == "next":
        return F.last(value, ignorenulls=True).over(after)
    if c.how == "last":
        return F.last(value, ignorenulls=True).over(before)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[c.how](value).over(before)


def _combine(c: Carry, local: Column, carried: Column) -> Column:
    if c.how in ("last", "next"):
        return F.coalesce(local, carried)
    if c.how in ("sum", "count"):
        return local + F.coalesce(carried, F.lit(0))
    return (F.greatest if c.how == "max" else F.least)(local, carried)


def per_stream(settings: DataFrame) -> DataFrame:
    """A table of a few rows per stream (settings, seeds, totals), to be joined by stream to rows of any number.

    It is sent to every task. A join that shuffles would gather each stream's rows, payloads included, in one task, and Spark counts that
    task's order as good for (stream, chunk) too. The size of a table made on the driver is unknown to it, so it is said here.
    """
    return F.broadcast(settings)


def quantile_bounds(df: DataFrame, order: str, rows_per_chunk: int = 250_000) -> list[float]:
    """Cuts of ``order`` (a number) into chunks of about ``rows_per_chunk`` rows whatever its distribution.

    One pass over that column alone; only the cuts come to the driver, eight bytes for ``rows_per_chunk`` rows.
    """
    total = df.count()
    chunks = max(2, -(-total // rows_per_chunk))
    share = [i / chunks for i in range(1, chunks)]
    bounds = df.agg(F.percentile_approx(F.col(order).cast("double"), share, max(1000, 10 * chunks)).alias("b")).first()["b"]
    return sorted(set(bounds or []))


def cut_at(df: DataFrame, order: str, bounds: list[float]) -> tuple[DataFrame, Column | None]:
    """The frame to scan and its chunk column for `quantile_bounds`; no chunk column for a single chunk."""
    if not bounds:
        return df, None
    splits = [-float("inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_order_value", outputCol="_quantile", handleInvalid="keep")
    out = cut.transform(df.withColumn("_order_value", F.col(order).cast("double"))).drop("_order_value")
    return out, F.col("_quantile").cast("long")


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """Median of ``value`` per key; a row counts ``weight`` times (once without). Equal values are counted before the shuffle to the key, so
    repeats cost nothing.

    The middle is found by counting from both ends: a sort and running sums, which spill, and no map of a key's values in memory.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    ends = {"_up": F.col(value).asc(), "_down": F.col(value).desc()}
    ranked = counts.select("*", *[F.sum("_n").over(W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, 0)).alias(c) for c, o in ends.items()])
    half = (F.col("_up") + F.col("_down") - F.col("_n")) / 2
    middle = ranked.where((F.col("_up") >= half) & (F.col("_down") >= half))
    return middle.groupBy(*keys).agg((0.5 * F.min(value) + 0.5 * F.max(value)).alias(name))
