import math

import numpy as np
from pyspark.sql import functions as F

from lockstep.llm import topk


def brute(rows, k, queries):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in good}:
        if queries(q):
            scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in good if i != q and len(v) == len(qv))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=10, queries=lambda q: q % 7 == 0):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int" if len(rows) and len(rows[0]) == 3 else "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 7 == 0, k)
    assert sorted(tuple(r) for r in got.collect()) == brute([r[:2] for r in rows], k, queries)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist(), 3) for i in range(500)]
    rows += [(1000 + i, [0.25, 0.25, 0.0, 0.0, 0.0], 1) for i in range(40)]  # ties
    rows += [(2000, None, 1), (2002, [1.0, None, 1.0, 1.0, 1.0], 1), (2003, [float("nan")] * 5, 1), (2004, [], 1), (2005, [1.0, 2.0], 1), (None, [1.0] * 5, 1), (2009, [float("inf")] * 5, 1)]
    check(spark, rows)


def test_large_items_and_few_rows(spark):
    check(spark, [(0, [1e6, -1e6]), (7, [1e6 + 0.001, 3.0]), (8, [-2e5, 1e6])])
    check(spark, [(7, [1.0])])
    check(spark, [])


def test_own_rows_take_no_place_in_a_leaf(spark):
    assert topk.LEAF_ROWS > 10
    rng = np.random.default_rng(2)
    tight = [(7 + i, (1.0 + rng.normal(size=4) / 1000).tolist()) for i in range(14)]  # 7 and 14 ask; one leaf holds all
    check(spark, tight)
    check(spark, tight[:11])  # ten others and no more
    far = [(1000 + i, (-5.0 + rng.normal(size=4)).tolist()) for i in range(200)]
    check(spark, tight + far)
    check(spark, tight + [(7, tight[0][1])] * 12 + far)  # repeated rows of an asking id
