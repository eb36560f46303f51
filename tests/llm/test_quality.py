import random
import zlib

import numpy as np
import pytest

from lockstep.llm import entries, quality as q

WORDS = [f"w{a}{b}" for a in "abcdefg" for b in "hijklmn"]


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = rng.choices(WORDS, k=rng.choice([30, 80]))
        docs.append((i, " ".join(words) + "." if good else "%%% ".join(words) + "%%%"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_word_vectors_equal_a_plain_loop(spark):
    texts = ["a b c a b", "", None, "c b a", "d", "a b c a b"]
    got = q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    index, total, n = q.index_vectors().astype(float), np.zeros((q.BUCKETS, q.WIDTH)), np.zeros(q.BUCKETS)
    for t in texts:
        bucket = q.tokens([t or ""])[1]
        for i, b in enumerate(bucket):
            n[b] += 1
            for k in range(max(0, i - q.REACH), min(len(bucket), i + q.REACH + 1)):
                if k != i:
                    total[b] += index[bucket[k]]
    want, there = np.zeros_like(total), n > 0
    mean = total[there] / n[there, None]
    mean -= (mean * n[there, None]).sum(0) / n.sum()
    want[there] = mean / np.maximum(1e-9, np.linalg.norm(mean, axis=1, keepdims=True))
    assert np.allclose(got, want, atol=1e-5)


def test_pooling_equals_a_plain_loop():
    vectors = np.random.default_rng(0).normal(size=(q.BUCKETS, q.WIDTH)).astype(np.float32)
    texts = ["x y z", "", "x", "y y y Q1 !!"]
    got = q.pooled(texts, vectors)
    for row, t in zip(got, texts, strict=True):
        v = vectors[q.tokens([t])[1]].astype(float)
        assert np.allclose(row, np.concatenate([v.mean(0), v.std(0)]) if len(v) else 0, atol=1e-4)


def test_index_vectors_are_sparse_and_balanced():
    v = q.index_vectors()
    assert (np.count_nonzero(v, axis=1) == q.NONZERO).all() and (v.sum(1) == 0).all()


def test_network_learns_what_no_single_layer_can():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (600, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    layers = q.fit_network(x[:400], y[:400])
    assert ((q.logits(x[400:], layers) > 0) == y[400:]).mean() > 0.93


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert q.best_temperature(z, y) == pytest.approx(1, rel=0.2)
    assert q.best_temperature(4 * z, y) == pytest.approx(4, rel=0.2)  # too sure by four


def test_query_on_held_out_rows_and_odd_texts(spark, tmp_path):
    docs, labels = corpus()
    long = " ".join(random.Random(1).choices(WORDS, k=150_000))
    docs += [(900, None), (901, ""), (902, long), (None, docs[1][1]), (5, docs[5][1])]
    labels += [(901, None, 0), (None, 1, 1), (5000, 0, 1)]
    rows = [(i, t, 9.0, True, i, 1) for i, t in docs]  # columns that clash with the result's
    spark.createDataFrame(rows, "doc_id long, text string, score double, predicted boolean, key long, label int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = entries.op2_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 80 and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score and by_id[902].predicted == 1


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(1, None)], 0.5), ([(77, 1)], 0.5)])
def test_labels_of_one_kind(spark, labels, want):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "c")], "doc_id long, text string")
    model = q.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [r.score for r in q.score(docs, model).collect()] == [want] * 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert q.score(empty, q.learn(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).count() == 0
