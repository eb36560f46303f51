import random

import pytest
from bitstreams import packets, serial_model, split, stream, streams
from pyspark.sql import functions as F

from lockstep.operators import frames as fr
from lockstep.operators import sync
from lockstep.plans.recording import raw_channel_means, run_lock


def run(spark, parts, per_chunk=3, **changes):
    table = packets(spark, {"a": parts}, per_chunk)
    config = streams(spark, ["a"], **changes)
    result = run_lock(table, config)
    words = spark.createDataFrame([("a", 0, "w0", 0)], "stream_id string, ord int, name string, word int")
    means = raw_channel_means(table, config, words, result)
    lock = [(r.t_abs, r.lock_pct, r.missed) for r in result.samples.orderBy("window_idx").collect()]
    raw = [r.raw_mean for r in means.orderBy("window_idx").collect()]
    return result, lock, raw


@pytest.mark.parametrize("rate_clock", [True, False])
def test_each_window_averages_its_own_frames(spark, rate_clock):
    bits = stream(1, 4, 5, 6, 7, 15)
    parts = [(bits, 5000.0)] if rate_clock else split(bits, 7, 1000.0)
    _, lock, raw = run(spark, parts, use_rate_clock=rate_clock)
    t0 = 0.0 if rate_clock else 1000.0
    assert lock == [(t0, 75.0, 0)] + [(t0 + 15 * k, 100.0, 0) for k in range(1, 5)]
    assert raw == [1, 4, 5, 6, 11]


@pytest.mark.parametrize("per_chunk", [1, 3, 1000])
def test_lost_lock_counts_missed_frames(spark, per_chunk):
    bits = stream(1, 4) + "0" * 30 + "1001" + stream(5, 6)[4:]
    _, lock, raw = run(spark, split(bits, 7, 0.0), per_chunk, use_rate_clock=True)
    assert [t for t, _, _ in lock] == [0, 15, 30, 45, 60, 75]
    assert [round(p, 9) for _, p, _ in lock] == [75, 100, 60, 0, round(1400 / 15, 9), 100]
    assert [m for _, _, m in lock] == [0, 0, 1, 2, 2, 2]
    assert raw == [1, 4, 0, 0, 5, 6]


def test_no_sync_afterwards_keeps_counting(spark):
    bits = stream(1) + "0" * 169
    result, lock, _ = run(spark, [(bits, 0.0)], use_rate_clock=True, period_ticks=10**13)
    assert lock[0][2] == 14 and lock[0][1] == pytest.approx(2400 / 185)
    events = sync.missed_frame_events(result.anchors, result.chunks, streams(spark, ["a"]))
    assert events.count() == 14


@pytest.mark.parametrize("rate, missed", [(0.0, [0, 0, 1, 2, 3, 4, 4, 4, 4]), (12.0, [0, 0, 15, 30, 45, 60, 60, 60, 60])])
def test_recording_gap(spark, rate, missed):
    tail = stream(5, 6, 7)[4:]
    _, lock, raw = run(spark, [(stream(1, 4), 1000.0), (tail, 1100.0)], 1, rate_bps=rate)
    assert [t for t, _, _ in lock] == [1000 + 15 * k for k in range(9)]
    assert raw == [1, 4, 0, 0, 0, 0, 0, 0, 6.5]
    assert [p for _, p, _ in lock] == [75, 100, 0, 0, 0, 0, 0, 0, 80]
    # The gap windows are those without a bit; 1000..1027 s and 1100.. hold some.
    assert [m for _, _, m in lock] == missed


@pytest.mark.parametrize("m, locked", [(2, 24 / 4), (3, 23 / 3)])
def test_min_syncs(spark, m, locked):
    bits = "1001001" + stream(1, 4, 7, 12)[4:]
    _, _, raw = run(spark, [(bits, 0.0)], use_rate_clock=True, period_ticks=10**13, min_syncs=m)
    assert raw == [pytest.approx(locked)]


def test_off_phase_sync_in_lock_is_data(spark):
    result, _, raw = run(spark, [(stream(1, 9, 4), 0.0)], use_rate_clock=True, period_ticks=10**13)
    outcome = sync.stream_outcome(packets(spark, {"a": [(stream(1, 9, 4), 0.0)]}), result.hits, result.anchors, result.samples).first()
    assert (outcome.syncs, outcome.frames, outcome.verdict) == (5, 3, "ok")
    assert raw == [pytest.approx(14 / 3)]


def test_off_phase_after_loss_is_not_extracted(spark):
    bits = "1001" + "0000" + "0" * 9 + "1001" + "1111" + "00001001"
    _, _, raw = run(spark, [(bits, 0.0)], use_rate_clock=True, period_ticks=10**13)
    assert raw == [15]


def test_outcomes(spark):
    parts = {"none": [("0" * 50, 0.0)], "hit": [("0" * 20 + "1001" + "0" * 30, 0.0)], "ok": [(stream(1, 2, 3), 0.0)]}
    table, config = packets(spark, parts), streams(spark, list(parts), use_rate_clock=True)
    result = run_lock(table, config)
    got = {r.stream_id: r.verdict for r in sync.stream_outcome(table, result.hits, result.anchors).collect()}
    assert got == {"none": "no_sync", "hit": "sync_no_frames", "ok": "ok"}
    assert {r.stream_id for r in result.samples.collect()} == {"ok"}
    assert sync.run_succeeded(sync.stream_outcome(table, result.hits, result.anchors)).first().success


def test_random_streams_match_a_bit_serial_model(spark):
    """Random frames, noise, gaps, splits and chunk sizes, all streams in one run."""
    rng = random.Random(7)
    parts, models, rows = {}, {}, []
    for k in range(60):
        size, sync_len = rng.choice([12, 17, 20]), 4
        m = rng.choice([1, 1, 2, 3])
        bits = "".join("1001" + "".join(rng.choice("01") for _ in range(size - 4)) for _ in range(rng.randint(2, 12)))
        bits = "".join(rng.choice("01") if rng.random() < 0.02 else b for b in bits)
        if rng.random() < 0.3:
            cut = rng.randint(1, len(bits) - 1)
            bits = bits[:cut] + bits[min(len(bits), cut + rng.randint(1, 5)):]
        items, t, i = [], 1000.0, 0
        while i < len(bits):
            n = rng.randint(1, 40)
            items.append((bits[i: i + n], t))
            t += len(bits[i: i + n]) + (rng.choice([40, 95]) if rng.random() < 0.1 else 0) - (20 if rng.random() < 0.05 else 0)
            i += n
        sid = f"s{k:02d}"
        parts[sid] = items
        models[sid] = serial_model(items, pattern=9, mask=15, sync_len=4, frame_bits=size, min_syncs=m, word_len=4,
                                   words=size // 4, period=15.0)
        rows.append((sid, size, m, size // 4))
    table = packets(spark, parts, per_chunk=2)
    sizes = spark.createDataFrame(rows, "stream_id string, f int, m int, w int")
    config = (streams(spark, list(parts)).join(sizes, "stream_id")
              .withColumns({"bits_in_frame": F.col("f"), "min_syncs": F.col("m"), "words_in_frame": F.col("w")}).drop("f", "m", "w"))
    result = run_lock(table, config)
    got = {}
    for r in result.samples.orderBy("stream_id", "window_idx").collect():
        got.setdefault(r.stream_id, []).append((r.t_abs, r.lock_pct, r.missed))
    words = sizes.select("stream_id", F.explode(F.sequence(F.lit(0), F.col("w") - 2)).alias("word")).withColumns(
        {"ord": F.col("word"), "name": F.concat(F.lit("w"), "word")})
    frames = {}
    for r in fr.demux_words(table, fr.extract_frames(result.anchors), result.chunks, config, words).collect():
        frames.setdefault((r.stream_id, r.end_bit), {})[r.word] = r.raw
    for sid, (samples, expected) in models.items():
        assert {b: list(v) for b, v in expected} == {b: [v[w] for w in sorted(v)] for (s, b), v in frames.items() if s == sid}, sid
        if not expected:
            assert sid not in got
            continue
        assert [(t, m) for t, _, m, _ in samples] == [(t, m) for t, _, m in got[sid]], sid
        assert [p for _, p, _, _ in samples] == pytest.approx([p for _, p, _ in got[sid]]), sid
    spans = sync.lock_spans(result.anchors, result.chunks, config).agg(F.sum(F.expr("bit_to - bit_from + 1"))).first()[0]
    assert spans > 0
