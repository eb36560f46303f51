"""Zoomed-out views from the stored index, and calibration by wide profiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lockstep.operators import lookup
from lockstep.operators.calibrate import calibrate_by_points, calibrate_piecewise, profile_points


def _rows(df):
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    names = sorted(df.columns)
    return sorted([tuple(cell(r[n]) for n in names) for r in df.collect()], key=repr)


@pytest.mark.parametrize("view", [(40.0, 260.0, 16), (-5.0, 1000.0, 7), (100.0, 100.5, 16)])
def test_indexed_envelope_is_the_walked_one(spark, tmp_path, view):
    rng, rows = random.Random(5), []
    for s, n in ((1, 3000), (2, 700), (3, 5), (4, 900)):
        x = 0.0
        for i in range(n):
            x += rng.choice([0.0, 0.05, 0.3]) if s != 4 else 0.01  # times repeat; series 4 ends before most views begin
            y = rng.uniform(-9, 9)
            if rng.random() < 0.004:
                y = rng.choice([math.nan, math.inf, -math.inf])
            rows.append((s, i, x, y))
    points = spark.createDataFrame(rows, "s int, idx long, x double, value double")
    stored = str(tmp_path / "index")
    lookup.write_view_index(lookup.view_index(points, ["s"], block=8, slab_level=3), stored)
    lo, hi, columns = view
    got = lookup.indexed_envelope(points, lookup.read_view_index(spark, stored), ["s"], lo, hi, columns, block=8, slab_level=3)
    want = lookup.envelope_or_raw(points, ["s"], lo, hi, columns)
    assert _rows(got) == _rows(want.select(*got.columns))


def test_view_index_roots_and_slabs(spark):
    points = spark.range(1000).selectExpr("1 AS s", "id AS idx", "double(id) AS x", "double(id) AS value")
    nodes = lookup.view_index(points, ["s"], block=8, slab_level=3).collect()
    assert [n.node for n in nodes if n.level == max(m.level for m in nodes)] == [0]
    assert {n.slab for n in nodes if n.level >= 3} == {-1} and {n.slab for n in nodes if n.level < 3} == set(range(16))
    root = next(n for n in nodes if n.level == 7)
    assert (root.n, root.y_sum, root.x_first, root.x_last, root.up_bad) == (1000, 499500.0, 0.0, 999.0, 1)


def test_samples_are_pruned_by_slab(spark, tmp_path):
    points = spark.range(20000).selectExpr("1 AS s", "id AS idx", "double(id) AS x", "double(id % 7) AS value", "id div 64 AS slab")
    points.repartition("slab").write.partitionBy("slab").parquet(str(tmp_path / "samples"))
    lookup.write_view_index(lookup.view_index(points, ["s"], block=8, slab_level=3), str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "samples")).withColumn("slab", F.col("slab").cast("long"))
    index = lookup.read_view_index(spark, str(tmp_path / "index"))
    got = lookup.indexed_envelope(stored, index, ["s"], 0.0, 19999.0, 5, block=8, slab_level=3, slab="slab")
    want = lookup.envelope_or_raw(points.drop("slab"), ["s"], 0.0, 19999.0, 5)
    assert _rows(got) == _rows(want.select(*got.columns))


def test_wide_profiles_equal_the_curve_of_an_array(spark):
    rng = random.Random(8)
    curves = {0: sorted((float(rng.randint(0, 40)), rng.uniform(-90, 0)) for _ in range(60)), 1: [(7.0, -3.0)], 2: [(1.0, 5.0), (1.0, 6.0), (4.0, 9.0), (4.0, 1.0)]}
    profiles = spark.createDataFrame([(w, w != 4, p) for w, p in (curves | {4: [(1.0, 1.0)]}).items()],
                                     "word int, valid boolean, points array<struct<raw_avg: double, true_db: double>>")
    raws = [None, -1.0, math.inf, *[i / 2 for i in range(90)]]
    counts = spark.createDataFrame([(n, w, r) for n, (w, r) in enumerate((w, r) for w in (0, 1, 2, 3, 4, None) for r in raws)], "id int, word int, raw double")
    got = {r.id: r.db for r in calibrate_by_points(counts, profile_points(profiles), rows_per_chunk=50).collect()}
    want = counts.join(profiles.where("valid"), "word", "left").select(
        "id", F.when(F.col("points").isNotNull() & F.col("raw").isNotNull(), calibrate_piecewise(F.col("raw"), F.col("points"))).alias("db")).collect()
    assert len(got) == len(want) == counts.count()
    for r in want:
        assert got[r.id] == (None if r.db is None else pytest.approx(r.db)), r
