from bitstreams import packets, split, stream, streams

from lockstep.plans.calibration import extract_calibration


def test_sweep_from_bits(spark):
    """4-bit words at 400 frames a second, each level held for six seconds of ten-frame samples."""
    bits = stream(*[level for level in (2, 5, 9, 14) for _ in range(240)])
    table = packets(spark, {"a": split(bits, 4000, 0.0)}, 2)
    config = streams(spark, ["a"], bit_ticks=20_833.0, use_rate_clock=True)
    words = spark.createDataFrame([("a", 0, "L_RCVR1", 0), ("b", 0, "L_RCVR1", 0)], "stream_id string, ord int, name string, word int")
    got = {r.stream_id: r for r in extract_calibration(table, config, words, [0.0, 6.0, 12.0, 18.0]).collect()}
    assert got["b"].outcome == "no_data"
    assert got["a"].outcome == "calibrated", got["a"]
    assert [(round(p.raw_avg), p.true_db) for p in got["a"].points] == [(2, 0), (5, 6), (9, 12), (14, 18)]
