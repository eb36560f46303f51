"""Chunks are composed exactly, in a number of passes that does not grow with them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.operators import sync


def composed(hits, drops, bounds, size, m):
    """Entry state of every chunk by exit maps, as the Spark pass does it."""
    anchor, count, out = -1, sync.NO_LOCK, []
    for lo, hi in zip(bounds, bounds[1:]):
        h, d = [x for x in hits if lo <= x < hi], [x for x in drops if lo <= x < hi]
        out.append((anchor, count))
        chunk = sync.ChunkExits(h, d, size, m)
        landing = chunk.step(anchor, count, 0)
        if landing:
            anchor, count = chunk.exit(*landing)
        elif d:
            count = sync.NO_LOCK
    return out


def test_exit_maps_agree_with_the_fold():
    rng = random.Random(3)
    for _ in range(3000):
        size, m, end = rng.choice([3, 7, 12]), rng.choice([1, 2, 3]), rng.choice([60, 200])
        hits = sorted(rng.sample(range(end), rng.randrange(1, end // 2)))
        if rng.random() < 0.5:
            hits = sorted({*hits[::4], *range(rng.randrange(size), end, size), *range(rng.randrange(size), end, size)})
        drops = sorted(rng.sample(range(1, end), rng.choice([0, 0, 1, 4])))
        bounds = [0, *sorted(rng.sample(range(1, end), rng.choice([1, 3, 9]))), end]
        anchor, count = -1, sync.NO_LOCK
        for (lo, hi), entry in zip(zip(bounds, bounds[1:]), composed(hits, drops, bounds, size, m)):
            assert entry == (anchor, count)
            h, d = np.array([x for x in hits if lo <= x < hi], int), np.array([x for x in drops if lo <= x < hi], int)
            _, anchor, count = sync.fold_hits(h, d, size, m, anchor, count)


@pytest.mark.parametrize("chunks", [4, 16])
def test_two_phases_take_as_many_passes_for_any_number_of_chunks(spark, monkeypatch, chunks):
    written = []
    real = sync.materialize
    monkeypatch.setattr(sync, "materialize", lambda df: written.append(1) or real(df))
    n, size = 2000, 800
    hits = spark.range(n).select(F.lit("s").alias("stream_id"), (F.col("id") * chunks / n).cast("long").alias("chunk"), (F.col("id") * 400).alias("bit"))
    streams = spark.createDataFrame([("s", size, 2)], "stream_id string, bits_in_frame long, min_syncs int")
    anchors = sync.lock_anchors(hits, streams)
    got = sorted((r.bit, r["count"], r.locked, r.missed, r.frame) for r in anchors.collect())
    rows, _, _ = sync.fold_hits(np.arange(n) * 400, np.zeros(0, int), size, 2, -1, sync.NO_LOCK)
    assert got == sorted((r[1], r[4], r[5], r[6], r[7]) for r in rows)
    assert len(written) == 2


def test_a_very_long_loss_is_listed_in_strides(spark, monkeypatch):
    monkeypatch.setattr(sync, "_MISSED_STRIDE", 7)
    anchors = spark.createDataFrame([("s", 0, 10, 10, -1, 1, 0, 23)], "stream_id string, chunk long, bit long, anchor long, prev long, count int, locked long, missed long").withColumn("kind", F.lit(1))
    chunks = spark.createDataFrame([("s", 0, 11)], "stream_id string, chunk long, n_bits long")
    streams = spark.createDataFrame([("s", 4, 1)], "stream_id string, bits_in_frame long, min_syncs int")
    assert sorted(r.bit for r in sync.missed_frame_events(anchors, chunks, streams).collect()) == [-1 + 4 * j + 1 for j in range(1, 24)]


def test_one_stream_is_searched_by_many_tasks(spark, monkeypatch):
    """The settings' join must not gather a stream's payloads: with one stream every chunk would be searched by one task."""
    from lockstep.operators import bits
    from lockstep.operators.config import prepare_streams

    rows = [("s", i, i // 4, 800, bytearray([i % 256] * 100)) for i in range(256)]
    packets = spark.createDataFrame(rows, "stream_id string, ord long, chunk long, n_bits long, payload binary")
    streams = prepare_streams(spark.createDataFrame(
        [("s", "FE6B2840", "", 800, 1.0, False, False, False, 10_000_000, False)],
        "stream_id string, sync_hex string, mask_hex string, bits_in_frame int, data_rate_mbps double, swap_bytes boolean, inverted boolean, "
        "randomized boolean, period_ticks long, use_rate_clock boolean"))
    scans = []
    monkeypatch.setattr(bits, "materialize", lambda df: scans.append(df) or df)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        bits.scan_packets(packets, streams)
        bits.transform_matrix(packets, streams, 800)
        for df in [*scans, bits.payload_edges(packets, streams)]:
            assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
