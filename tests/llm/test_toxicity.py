import random
import zlib

import numpy as np
import pytest

from lockstep.llm import entries, toxicity as tx

WORDS = [f"w{a}{b}" for a in "abcdefg" for b in "hijklmn"]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.choice([20, 60]))
        toxic = i % 6 == 0
        if toxic:
            words[3] = words[9] = "grumblefish"
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    return docs, labels


def plain_risk(w, x, confirmed, prior):
    """The risk of the docstring, row by row."""
    def loss(row, sign):
        z = sum(a * b for a, b in zip(row, w[:-1])) + w[-1]
        return 1 / (1 + np.exp(sign * z))

    positive = [r for r, c in zip(x, confirmed) if c]
    others = [r for r, c in zip(x, confirmed) if not c]
    p_plus = sum(loss(r, 1) for r in positive) / len(positive)
    p_minus = sum(loss(r, -1) for r in positive) / len(positive)
    rest = sum(loss(r, -1) for r in others) / len(others) - prior * p_minus
    return prior * p_plus + max(0.0, rest), rest


def test_training_lowers_the_plain_risk():
    rng = np.random.default_rng(0)
    toxic = rng.random(300) < 0.3
    x = (rng.random((300, 5)) < np.where(toxic[:, None], [0.9, 0.6, 0.2, 0.2, 0.2], [0.05, 0.2, 0.2, 0.2, 0.2])).astype(np.float32)
    x, confirmed = np.vstack([x[toxic], x]), np.arange(toxic.sum() + 300) < toxic.sum()
    start, _ = plain_risk(np.zeros(6), x.tolist(), confirmed, 0.3)
    w = tx.non_negative_pu(x, confirmed, 0.3)
    risk, rest = plain_risk(w, x.tolist(), confirmed, 0.3)
    assert risk < 0.4 * start and rest > -0.02
    called = x[~confirmed] @ w[:-1] + w[-1] > 0
    assert (called == toxic).mean() > 0.85


def test_first_step_follows_the_risk_by_differences():
    rng = np.random.default_rng(4)
    x, confirmed = rng.random((40, 3)).astype(np.float32), np.arange(40) < 12
    risk = lambda w: plain_risk(w, x.tolist(), confirmed, 0.25)[0]
    at = np.zeros(4)
    slope = np.array([(risk(at + 1e-4 * e) - risk(at - 1e-4 * e)) / 2e-4 for e in np.eye(4)])
    step = tx.non_negative_pu(x, confirmed, 0.25, steps=1)
    assert np.array_equal(np.sign(step), -np.sign(slope))  # Adam's first step has the size of its rate and the sign of the slope


def test_negative_part_is_not_pushed_below_zero():
    """The confirmed rows hold all of the prior's mass: without the correction the second part would go on falling."""
    x = np.vstack([np.eye(20), np.eye(20)[:10], np.zeros((10, 20))]).astype(np.float32)
    confirmed = np.arange(40) < 20
    _, rest = plain_risk(tx.non_negative_pu(x, confirmed, 0.5, steps=400), x.tolist(), confirmed, 0.5)
    assert rest > -0.1


def test_lookup_finds_presence_once_per_text():
    texts = ["Abcdexx abcdexx", "", "q", "xyz abcdezz abcdezy", "zzz"]  # the fourth shares beginnings alone
    h = tx.text_features(["abcdexx"])[1]
    got = tx.Lookup(np.unique(h)).pairs(texts)
    assert sorted(set(got[0].tolist())) == [0, 3] and len(set(zip(*map(np.ndarray.tolist, got)))) == len(got[0])


def test_frequencies_count_every_row_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "grumble x"), (None, "grumble"), (2, None), (2, "y grumble grumble"), (3, "z")], "doc_id long, text string").repartition(3)
    lookup = tx.Lookup(np.unique(tx.text_features(["grumble"])[1]))
    assert tx.corpus_frequency(docs, lookup).tolist() == [3] * len(lookup.sorted)


def test_query_on_held_out_rows_and_odd_texts(spark, tmp_path):
    docs, labels = corpus()
    long = " ".join(random.Random(1).choices(WORDS, k=150_000))
    docs += [(900, None), (901, ""), (902, long), (903, long + " grumblefish grumblefish"), (None, docs[1][1]), (5, docs[5][1])]
    labels += [(901, None, 0), (None, 1, 1), (5000, 1, 1)]
    rows = [(i, t, 9.0, True, i) for i, t in docs]  # columns that clash with the result's
    spark.createDataFrame(rows, "doc_id long, text string, score double, predicted boolean, h long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = entries.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 80 and sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[900] == by_id[901] and by_id[903] > by_id[902]


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None)], [(77, 1)], [(None, 1)]])
def test_nothing_confirmed_scores_zero(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "c")], "doc_id long, text string")
    model = tx.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.score for r in tx.score(docs, model).collect()] == [0.0] * 3


def test_only_toxic_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "bad words here") for i in range(8)], "doc_id long, text string")
    model = tx.learn(docs, spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in tx.score(docs, model).collect())
    empty = docs.limit(0)
    assert tx.score(empty, tx.learn(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).count() == 0


def test_labels_of_absent_rows_do_not_count(spark):
    """As in a pipeline whose earlier stage removed most labelled rows: the prior is that of the rows that are there."""
    docs, labels = corpus(240)
    there = spark.createDataFrame(docs, "doc_id long, text string")
    own = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    more = own.unionByName(spark.createDataFrame([(10_000 + i, 1, 1) for i in range(4000)], own.schema))
    a, b = tx.learn(there, own), tx.learn(there, more)
    assert np.array_equal(a.lookup.sorted, b.lookup.sorted) and np.allclose(a.weights, b.weights, atol=1e-3)
