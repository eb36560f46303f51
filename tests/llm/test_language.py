import random
import zlib

import numpy as np

from lockstep.llm import entries, language

STEMS = {"aa": "lorem dolor amet sit ipsum", "bb": "schön groß weiß über straße", "cc": "niño año señor mañana", "dd": "être garçon élève où"}


def make(lang, rng, n):
    return " ".join(rng.choice(STEMS[lang].split()) + rng.choice(["", "s", "en"]) for _ in range(n))


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = language.codewords(n)
        apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert apart >= max(1, code.shape[1] // 4)


def test_features_treat_texts_alone_and_equal():
    texts = ["", "Ab, ab!", "12 3", "ab", "漢字"]
    x, known = language.features(texts)
    assert known.tolist() == [False, True, False, True, True] and x[0].sum() == 0
    for t, row in zip(texts, x, strict=True):
        assert np.allclose(language.features([t])[0][0], row)


def test_query_on_held_out_rows_and_odd_texts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, make(lang, rng, rng.choice([3, 30])), lang if i % 9 else None, 0.5) for i, lang in enumerate(rng.choices(list(STEMS), k=600))]
    rows += [(1000, None, "aa", 1.0), (1001, "", "aa", 1.0), (1002, "12 !!", "bb", 1.0), (None, "être où", "dd", 1.0), (3, "lorem sit", "aa", 1.0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = entries.op5_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, t in ((r[0], r[1]) for r in rows)}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in (truth[r.doc_id] or ""))) and 0 <= r.score <= 1
    names = {i: r[2] for i, r in enumerate(rows[:600])}
    held = [r for r in got if r.held_out and names.get(r.doc_id)]
    assert len(held) > 50 and sum(r.lang_pred == names[r.doc_id] for r in held) >= 0.97 * len(held)
    bare = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{bare}/documents.parquet")
    assert entries.op5_language(spark, bare).count() == 0


def test_no_and_one_language(spark):
    docs = spark.createDataFrame([(1, "ab", None), (2, "1", None)], "doc_id long, text string, lang string")
    none = language.learn(docs)
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    one = language.learn(spark.createDataFrame([(1, "ab", "xx")], "doc_id long, text string, lang string"))
    assert sorted(r.lang_pred for r in language.predict(docs, one).collect()) == ["und", "xx"]


def test_costs_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    code = language.codewords(7)
    model = language.CodeModel(list("abcdefg"), code, rng.normal(size=(language.BUCKETS + 1, code.shape[1])), rng.random(code.shape[1]))
    x = rng.random((4, language.BUCKETS))
    want = [[sum(t * np.log1p(np.exp(-c * (row @ w[:-1] + w[-1]))) for c, w, t in zip(word, model.weights.T, model.trust)) for word in code] for row in x]
    assert np.allclose(model.costs(x), want)


def test_tied_codewords_go_to_the_first_language():
    model = language.CodeModel(["aa", "bb"], np.array([[1.0], [-1.0]]), np.zeros((language.BUCKETS + 1, 1)), np.ones(1))
    names, score, unsure = model.predict(["x", "1"])
    assert names == ["aa", "und"] and score.tolist() == [0.5, 0.0] and unsure.all()


def test_every_language_is_learned_however_rare(spark, monkeypatch):
    """260 languages, one of them with half of all rows, and 250 of three rows each."""
    rng = random.Random(9)
    marks = {f"l{i:03d}": [chr(0x4E00 + 7 * i + k) for k in range(6)] for i in range(260)}
    size = lambda lang: 1200 if lang == "l000" else 40 if lang < "l010" else 3
    rows = [(len(marks) * n + i, "".join(rng.choices(marks[lang], k=30)), lang) for i, lang in enumerate(marks) for n in range(size(lang))]
    docs = spark.createDataFrame(rows + [(None, None, "l001"), (None, "12", "l002")], "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(language, "MOST_ROWS", 260 * 20)
    model = language.learn(docs)
    assert model.languages == sorted(marks)
    names, _, _ = model.predict(["".join(rng.choices(m, k=30)) for m in marks.values()])
    assert sum(a == b for a, b in zip(names, marks, strict=True)) >= 0.97 * len(marks)
