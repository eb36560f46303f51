import hashlib
import random

import numpy as np

from lockstep.llm import entries, fingerprints as fp


def slow_syncmers(text):
    """Anchors by their definition, on the S-gram hashes of the operator."""
    out = []
    for i in range(len(text) - fp.K + 1):
        t, p, _ = fp.syncmers([text[i:i + fp.K]])
        if len(t):
            out.append(i)
    return out


def test_anchors_depend_on_their_gram_alone():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdé漢 ", k=n)) for n in (0, 3, 16, 17, 200, 90)]
    text, position, h = fp.syncmers(texts)
    for i, t in enumerate(texts):
        assert position[text == i].tolist() == slow_syncmers(t)
    alone = fp.syncmers([texts[4]])
    assert (alone[2] == h[text == 4]).all()


def test_batch_cuts_do_not_matter(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcd ", k=n)) for n in (100, 0, 50, 300, 20)]
    together = fp.sketches(texts)
    for t, s in zip(texts, together, strict=True):
        one = fp.sketches([t])[0]
        assert np.array_equal(one[0], s[0]) and np.array_equal(one[1], s[1])


def test_query_against_plain_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rng = random.Random(6)
    words = ["alpha", "beta", "gämma", "delta", "漢字", "x"]
    texts = [None, "", "a", "ab", "abc"] + [" ".join(rng.choices(words, k=rng.choice([2, 50, 400]))) for _ in range(60)]
    ids = rng.sample(range(-50, 900), len(texts))
    rows = list(zip(ids, texts, ["x"] * len(texts), strict=True))
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in entries.op4_fingerprint(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        want = fp.edited(t, nxt)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        s, e, n = (fp.sketches([x])[0] for x in (t, want, nxt))
        assert got[i].fingerprint == fp.written(t, s) and got[i].edited_fingerprint == fp.written(want, e)
        assert got[i].near_edited == fp.likeness(s, e, t == want) and got[i].near_next == fp.likeness(s, n, t == nxt)
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited > 0.15 for r in long) > 0.8 * len(long)


def test_query_ties_nulls_single_and_empty(spark, tmp_path):
    for name, rows in {"one": [(5, "alone here")], "same": [(1, "t"), (1, "t"), (1, "u"), (None, "n"), (None, None)], "none": []}.items():
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = entries.op4_fingerprint(spark, f"{tmp_path}/{name}").collect()
        assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)


def test_ranges_stay_even(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    texts = [f"text {i} " + "".join(rng.choices("abcd ", k=30)) for i in range(2400)]

    def most(ids):
        order = "coalesce(doc_id, -9223372036854775808) AS order"
        rows = spark.createDataFrame(list(zip(ids, texts, strict=False)), "doc_id long, text string").selectExpr("doc_id AS key", order, "text")
        return max(r["count"] for r in fp._ranges(rows).groupBy("range").count().collect())

    monkeypatch.setattr(fp, "RANGE_ROWS", 50)
    assert most([None if i % 3 else i for i in range(600)]) < 120  # null ids are cut too
    assert most([i if i % 2 else 77 for i in range(600)]) < 120  # and the rows of one id
    assert most([*range(598), None, 2**63 - 1]) < 120
    monkeypatch.setattr(fp, "RANGE_ROWS", 1)
    assert most([*range(2398), None, 2**63 - 1]) < 12  # more than 2000 ranges asked for
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    ids = [None if i % 3 == 0 else 5 if i % 3 == 1 else -(2**63) + i % 2 * i for i in range(120)]
    spark.createDataFrame(list(zip(ids, texts, strict=False)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entries.op4_fingerprint(spark, str(tmp_path)).select("doc_id", "edited_sha256").collect()
    h = {r.text: r.h for r in spark.createDataFrame([(t,) for t in texts[:120]], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(zip(ids, texts, strict=False), key=lambda r: (-(2**63) if r[0] is None else r[0], r[0] is not None, h[r[1]]), reverse=True)
    want = [(i, hashlib.sha256(fp.edited(t, order[(k + 1) % 120][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def plain_likeness(a, b, equal):
    """Likeness by its definition, over dicts of hash and position."""
    a, b = (dict(zip(s[0].tolist(), s[1].tolist(), strict=True)) for s in (a, b))
    if equal:
        return 1.0
    joint = sorted(a.keys() | b.keys())[:fp.ANCHORS]
    shift = [a[h] - b[h] for h in sorted((h for h in joint if h in a and h in b), key=a.get)]
    steady = [abs(x - y) <= fp.DRIFT for x, y in zip(shift, shift[1:], strict=False)]
    kept = sum(x or y for x, y in zip([False, *steady], [*steady, False], strict=True)) if len(shift) > 1 else len(shift)
    return kept / len(joint) if a and b else 0.0


def test_edited_texts_are_not_hashed_again(monkeypatch):
    rng, hashed = random.Random(8), []
    plain = fp.code_points
    monkeypatch.setattr(fp, "code_points", lambda texts: (hashed.append(sum(map(len, texts))), plain(texts))[1])
    for letters in ("a", "ab ", "abcdé漢😀 \n"):
        texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 15, 16, 17, 31, 32, 33, 90, 900, 4000]))) * rng.choice([1, 1, 3]) for _ in range(60)]
        texts += texts[:3]
        hashed.clear()
        mine, theirs = fp.chained(texts)
        assert sum(hashed) <= sum(map(len, texts)) + 2 * fp.K * len(texts)
        changed = [fp.edited(x, y) for x, y in zip(texts, texts[1:], strict=False)]
        equal = np.array([x == y for x, y in zip(texts, changed, strict=False)])
        near = fp.likenesses(mine.part(0, len(changed)), theirs, equal)
        for i, x in enumerate(changed):
            whole, own = fp.sketches([x])[0], fp.sketches([texts[i]])[0]
            assert np.array_equal(theirs.one(i)[0], whole[0]) and np.array_equal(theirs.one(i)[1], whole[1])
            assert np.array_equal(mine.one(i)[0], own[0]) and near[i] == plain_likeness(own, whole, equal[i])


def test_a_range_is_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 50)
    rows = [(None if i % 40 == 0 else i, f"text {i}") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entries.op4_fingerprint(spark, str(tmp_path)).selectExpr("spark_partition_id() AS task").groupBy("task").count().collect()
    assert sum(r["count"] for r in got) == 1500 and max(r["count"] for r in got) < 100
