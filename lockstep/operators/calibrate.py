"""Raw counts to dB: linear and measured piecewise curves, and attaching curves to word maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.operators.config import FULL_SCALE, VOLT_HIGH, VOLT_LOW
from lockstep.operators.scans import Carry, cut_at, ordered_scan, quantile_bounds


def linear_coefficients(polarity: Column, slope_idx: Column, db_per_volt: Column) -> tuple[Column, Column]:
    """(slope, offset) of the linear model, from polarity (1 is negative), voltage range and dB per volt."""
    def volts(values: list[float]) -> Column:
        return F.try_element_at(F.array(*[F.lit(v) for v in values]), slope_idx + 1) * db_per_volt

    low, high = volts(VOLT_LOW), volts(VOLT_HIGH)
    negative = polarity == 1
    slope = (high - low) / FULL_SCALE * F.when(negative, -1).otherwise(1)
    offset = F.when(negative, -high / (high - low) * FULL_SCALE).otherwise(low / (high - low) * FULL_SCALE)
    return slope, offset


def calibrate_linear(raw: Column, slope: Column, offset: Column) -> Column:
    return (raw + offset) * slope


def calibrate_piecewise(raw: Column, points: Column) -> Column:
    """Linear between points (``array<struct<raw_avg,true_db>>`` sorted by raw), clamped outside.

    Points with the same raw count read the lower-placed one; one point is a constant; no points leave the count as it is.
    """
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    # The first point at or above the value ends its segment.
    at = F.size(F.filter(points, lambda p: p.raw_avg < raw))
    low, high = F.try_element_at(points, F.greatest(at, F.lit(1))), F.try_element_at(points, at + 1)
    run = high.raw_avg - low.raw_avg
    inside = F.when(run == 0, low.true_db).otherwise(
        low.true_db + F.try_divide(high.true_db - low.true_db, run) * (raw - low.raw_avg))
    return (F.when(F.size(points) == 0, raw).when(F.size(points) == 1, first.true_db)
            .when(raw <= first.raw_avg, first.true_db).when(raw >= last.raw_avg, last.true_db).otherwise(inside))


def apply_calibration(raw: Column, slope: Column, offset: Column, points: Column | None = None) -> Column:
    """The measured curve where there is one, else the linear model."""
    linear = calibrate_linear(raw, slope, offset)
    return linear if points is None else F.when(points.isNotNull(), calibrate_piecewise(raw, points)).otherwise(linear)


def profile_points(profiles: DataFrame) -> DataFrame:
    """The points of valid profiles as rows (``word, i, raw_avg, true_db``), for `calibrate_by_points`."""
    return profiles.where("valid").select("word", F.posexplode("points").alias("i", "p")).select("word", "i", "p.*")


def calibrate_by_points(counts: DataFrame, points: DataFrame, key: str = "word", raw: str = "raw", rows_per_chunk: int = 250_000) -> DataFrame:
    """``counts`` with ``db``, as `calibrate_piecewise` gives it, for profiles of any width held as rows (``key, i, raw_avg, true_db``).

    A range join without pairs: the distinct counts of a key and its points are one ordered line, cut into chunks of equal size; each count
    finds the last point below it and the first at or above it in one scan. Keys without points and null counts get null.
    """
    value = F.col(raw).cast("double")
    asked = counts.select(F.col(key), value.alias("_raw")).where(F.col(key).isNotNull() & F.col("_raw").isNotNull()).distinct()
    point = F.struct("i", "raw_avg", "true_db")
    line = asked.withColumn("_i", F.lit(-1).cast("long")).unionByName(  # a count stands before the points at its place
        points.where(F.col(key).isNotNull()).select(key, F.col("raw_avg").cast("double").alias("_raw"), F.col("i").cast("long").alias("_i"), point.alias("_point")),
        allowMissingColumns=True)
    line, cut = cut_at(line, "_raw", quantile_bounds(line, "_raw", rows_per_chunk))
    found = ordered_scan(line, [key], ["_raw", "_i"], [Carry("_low", F.col("_point"), "last"), Carry("_high", F.col("_point"), "next")], cut).where("_i = -1")
    ends = points.groupBy(key).agg(F.max_by("raw_avg", "i").alias("_top_raw"), F.max_by("true_db", "i").alias("_top_db"))
    low, high = F.col("_low"), F.col("_high")
    slope = F.try_divide(high.true_db - low.true_db, high.raw_avg - low.raw_avg)
    db = F.when(low.isNull(), high.true_db).when(F.col("_raw") >= F.col("_top_raw"), F.col("_top_db")).otherwise(low.true_db + slope * (F.col("_raw") - low.raw_avg))
    curve = found.join(ends, key).select(F.col(key).alias("_key"), F.col("_raw").alias("_at"), db.alias("db"))
    return counts.join(curve, (F.col(key) == F.col("_key")) & (value == F.col("_at")), "left").drop("_key", "_at")


def attach_profiles(word_map: DataFrame, profiles: DataFrame) -> DataFrame:
    """Word map with the valid profile of each word (``points``; null means linear). Of two profiles for a word the first wins."""
    keyed = profiles.withColumn("_at", F.col("profile_no") if "profile_no" in profiles.columns else F.lit(0))
    chosen = keyed.groupBy("word").agg(F.min_by(F.struct("valid", "points"), "_at").alias("p"))
    usable = chosen.where("p.valid").select("word", F.col("p.points").alias("points"))
    return word_map.join(usable, "word", "left")


def attach_counts(word_map: DataFrame, profiles: DataFrame, attached: DataFrame) -> DataFrame:
    """How many profiles were given and how many parameters got one: given but none attached points at a wrong word map."""
    given = profiles.agg(F.count_distinct("word").alias("provided"))
    return given.join(attached.agg(F.count_if(F.col("points").isNotNull()).alias("attached"),
                                   F.count(F.lit(1)).alias("parameters")), F.lit(True))


def register_functions(spark: SparkSession) -> None:
    """SQL functions ``calibrate_linear(raw, slope, offset)`` and ``calibrate_piecewise(raw, points)``.

    SQL bodies, so Catalyst inlines them and no Python runs.
    """
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION calibrate_linear(raw DOUBLE, slope DOUBLE, off DOUBLE) "
              "RETURNS DOUBLE RETURN (raw + off) * slope")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION calibrate_piecewise(raw DOUBLE, points ARRAY<STRUCT<raw_avg: DOUBLE, true_db: DOUBLE>>)
        RETURNS DOUBLE RETURN CASE
          WHEN size(points) = 0 THEN raw
          WHEN size(points) = 1 OR raw <= points[0].raw_avg THEN points[0].true_db
          WHEN raw >= try_element_at(points, -1).raw_avg THEN try_element_at(points, -1).true_db
          ELSE (SELECT b.lo.true_db + coalesce(try_divide(b.hi.true_db - b.lo.true_db, b.hi.raw_avg - b.lo.raw_avg), 0)
                       * (raw - b.lo.raw_avg)
                FROM (SELECT try_element_at(points, size(filter(points, p -> p.raw_avg < raw))) AS lo,
                             try_element_at(points, size(filter(points, p -> p.raw_avg < raw)) + 1) AS hi) AS b)
        END""")
