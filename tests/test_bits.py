import random
import tracemalloc

import numpy as np
from bitstreams import PACKET_SCHEMA
from pyspark.sql import functions as F

from lockstep.functions import bits as kernels
from lockstep.operators import bits, lookup
from lockstep.operators.scans import Carry, cut_at, ordered_scan, quantile_bounds


def stream_packets(spark, payloads, per_chunk=2):
    rows = [("s", i, i // per_chunk, 8 * len(p), 0, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, PACKET_SCHEMA)


def noisy(rng, sync: str, frames: int, size: int) -> str:
    return "".join(sync + "".join(rng.choice(list("01"), size - len(sync))) for _ in range(frames))


def test_search_and_discovery(spark):
    rng = np.random.default_rng(3)
    text = noisy(rng, f"{0xFE6B2840:032b}", 12, 800)
    text += "0" * ((-len(text)) % 8)
    data = np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).tobytes()
    cuts = sorted(rng.choice(np.arange(2, len(data) - 2), 25, replace=False))
    payloads = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
    config = spark.createDataFrame([("s", 0xFE6B2840, 0xFFFFFFFF, 32, False, False, False)],
                                   "stream_id string, pattern long, mask long, sync_len int, swap_bytes boolean, inverted boolean, randomized boolean")
    table = stream_packets(spark, payloads, 1)
    want = [i for i in range(31, len(text)) if text[i - 31: i + 1] == f"{0xFE6B2840:032b}"]
    assert sorted(r.bit for r in bits.sync_hits(table, config).collect()) == want
    best = bits.transform_matrix(table, config, 800).where("rank = 1").first()
    assert (best.swap, best.invert, best.randomized, best.lsb_first, best.hits) == (False, False, False, False, len(want))
    found = bits.discover_sync(table).where("place = 1").first()
    positions: dict[int, list[int]] = {}
    for i in range(len(text) - 31):
        positions.setdefault(int(text[i: i + 32], 2), []).append(i)
    on_grid = max(np.unique(np.array(p) % 800, return_counts=True)[1].max() for p in positions.values())
    assert found.period == 800 and found.on_grid == on_grid and found.hits == len(positions[found.word])


def test_descrambler_round_trip(spark):
    rng = np.random.default_rng(5)
    plain = rng.integers(0, 2, 1600)
    sent = np.zeros(1600, int)
    for i in range(1600):
        sent[i] = plain[i] ^ (sent[i - 14] if i >= 14 else 0) ^ (sent[i - 15] if i >= 15 else 0)
    data = np.packbits(sent.astype(np.uint8)).tobytes()
    payloads = [data[a:b] for a, b in zip([0, 1, 2, 30, 31, 77], [1, 2, 30, 31, 77, 200])]
    out = bits.derandomize(stream_packets(spark, payloads, 1)).orderBy("ord").collect()
    assert b"".join(bytes(r.payload) for r in out) == np.packbits(plain.astype(np.uint8)).tobytes()


def test_chunked_scans_equal_whole_ones(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 501).alias("o"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"))
    carries = [Carry(f"{how}{inc}", F.col("v"), how, inc) for how in ("sum", "count", "max", "min", "last", "next") for inc in (True, False)]
    cut, chunk = cut_at(df, "o", quantile_bounds(df, "o", rows_per_chunk=40))
    whole = ordered_scan(df, ["k"], ["o"], carries)
    split = ordered_scan(cut, ["k"], ["o"], carries, chunk).select(*whole.columns)
    assert chunk is not None and sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


def test_masks_and_words():
    data = np.frombuffer(bytes(range(64)), np.uint8)
    text = "".join(f"{b:08b}" for b in data)
    lead = kernels.with_history(data, 512, "", False)
    for mask in (0xFF00FF, 0x1F, 0xFFFF):
        for pattern in (0x050007, 0x07, 0x0A0B):
            want = [i for i in range(512) if int(text[max(0, i - 63): i + 1], 2) & mask == pattern]
            assert kernels.find_pattern(lead, 512, pattern, mask).tolist() == want
    starts = np.array([-7, 0, 3, 100, 500])
    whole = kernels.word_values(data, 512, starts, 16).tolist()
    padded = "0" * 16 + text + "0" * 16
    assert whole == [int(padded[s + 16: s + 32], 2) for s in starts]


def test_range_summary(spark):
    points = spark.range(300).select((F.col("id") % 2).alias("s"), F.expr("id div 2").alias("idx"), (F.col("id") * 37 % 101).cast("double").alias("value"))
    index = lookup.rollup_index(points, ["s"])
    for lo, hi in ((0, 150), (5, 20), (31, 149), (0, 1000)):
        got = lookup.summarize_range(points, index, ["s"], lo, hi).orderBy("s").collect()
        want = points.where(F.col("idx").between(lo, hi - 1)).groupBy("s").agg(F.min("value"), F.max("value"), F.sum("value")).orderBy("s").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_range_summary_skips_values_that_are_not_finite_wherever_they_are(spark):
    bad = {5: float("nan"), 50: float("inf"), **{i: float("nan") for i in range(64, 96)}}
    points = spark.createDataFrame([("s", i, bad.get(i, float(i))) for i in range(200)], "s string, idx long, value double")
    index = lookup.rollup_index(points, ["s"])
    for lo, hi in ((1, 100), (32, 100), (0, 200), (64, 96), (60, 97), (199, 200), (0, 500), (7, 7)):
        want = [float(i) for i in range(lo, min(hi, 200)) if i not in bad]
        got = lookup.summarize_range(points, index, ["s"], lo, hi).collect()
        if want:
            assert (got[0].y_min, got[0].y_max, got[0].y_sum) == (min(want), max(want), sum(want))
        else:
            assert not got or got[0].y_min is None


def test_envelope_is_bounded_by_its_view(spark):
    rows = [("long", i, float(i), float(i % 7)) for i in range(5000)] + [("short", i, 10.0 * i, 1.0) for i in range(500)]
    points = spark.createDataFrame(rows, "s string, idx long, x double, value double")
    got = lookup.envelope_or_raw(points, ["s"], 1000.0, 2024.0, 128).collect()
    dense = sorted((r.column, r.n) for r in got if r.decimated)
    assert dense == [(-1, 1), *[(c, 8) for c in range(127)], (127, 9), (128, 1)]
    assert sorted(r.x for r in got if not r.decimated) == [10.0 * i for i in range(99, 204)]


def test_payload_transforms_keep_lengths_and_nulls(spark):
    rows = [(i, bytes([(7 * i + j) % 256 for j in range(i)]) if i % 4 != 3 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "ord int, payload binary").coalesce(1)
    want = {i: p for i, p in rows}
    for change, one in ((bits.swap_bytes, lambda p: p if len(p) % 2 else bytes(p[j ^ 1] for j in range(len(p)))),
                        (bits.invert_bits, lambda p: bytes(255 - x for x in p)), (bits.reverse_bits, lambda p: bytes(int(f"{x:08b}"[::-1], 2) for x in p))):
        for r in change(df).collect():
            assert (r.payload is None) == (want[r.ord] is None) and (r.payload is None or bytes(r.payload) == one(want[r.ord]))


def test_swapping_a_batch_takes_little_beyond_the_batch():
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 2, 3, 4, 4000, 4001, 300_000, 300_001]) for _ in range(200)] + [0, 0]
    offsets = np.cumsum([0, *sizes]).astype(np.int32)
    data = np.frombuffer(rng.randbytes(int(offsets[-1])), np.uint8)
    tracemalloc.start()
    got = bits._swapped(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tobytes() == b"".join(kernels.swap_pairs(data[a:b]).tobytes() for a, b in zip(offsets, offsets[1:]))
    assert peak < 3 * data.size
