import itertools
import random
import re

import numpy as np

from lockstep.llm import entries, interactions

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_fails(text):
    words = WORD.findall(text)
    return {c for c, failed in zip("ABCD", (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        re.search(r"[#$%&*|]", text) is not None), strict=True) if failed}


def plain_audit(docs, labels):
    """Every order walked document by document."""
    marked = []
    for doc_id, text, part in docs:
        text = text or ""
        fails = plain_fails(text)
        if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs):
            fails.add("E")
        good, toxic = (any(x[0] == doc_id and x[i] == 1 for x in labels) and doc_id is not None for i in (1, 2))
        marked.append((part or "", fails, good, toxic))
    out = {}
    for part in {m[0] for m in marked}:
        rows = [m for m in marked if m[0] == part]
        worth = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                worth[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in m[1] for m in rows) - len(gone), sum(m[1] == {f} for m in rows), sum(m[2] for m in gone),
                    sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(worth[order[step - 1]])
    return out


def some_documents(rng, n):
    base = ["", " ", None, "a # b", "WORD " * 250, "w " * 250, " ".join(map(str, range(250))), " ".join(f"x{i}" for i in range(199)),
            " ".join(f"é{i}" for i in range(200)), "a\x1cb\x85c" * 100, "x " * 300, "X" + "y" * 49, "X" + "y" * 48]
    texts = [rng.choice(base) if rng.random() < 0.7 else " ".join(rng.choices(["aa", "B", "c%", "é", "dd\n"], k=rng.choice([3, 210]))) for _ in range(n)]
    return [(rng.choice([None, *range(n)]), t, rng.choice([None, "", "s", "r"])) for t in texts]


def test_audit_equals_every_order_walked(spark):
    rng = random.Random(5)
    docs = some_documents(rng, 120)
    docs += docs[:5]  # repeated rows
    labels = [(rng.choice([None, *range(120)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(100)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, fails int, part string")
    got = interactions.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(got) == len(found) and found == plain_audit(docs, labels)


def test_weighted_planes_equal_plain_sums():
    rng = np.random.default_rng(2)
    tally = interactions.PositionalCount()
    want = np.zeros(32, np.int64)
    for size in (0, 1, 2, 3, 100, 1001):
        words = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        copies = rng.integers(0, 70_000, size)
        tally.add(words, copies)
        want += ((words[:, None] >> np.arange(32) & 1) * copies[:, None]).sum(0)
    assert tally.counts().tolist() == want.tolist() and all(len(p) <= 2 for p in tally.planes)


def test_words_hold_the_surviving_subsets():
    assert interactions.WORDS[0] == 0xFFFFFFFF and interactions.WORDS[31] == 1
    assert all((int(interactions.WORDS[m]) >> s & 1) == (not s & m) for m in range(32) for s in range(32))


def test_many_parts_leave_a_task_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(interactions, "HELD_KEYS", 2)
    rows = spark.createDataFrame([(f"p{i % 9}", 0, 1, i % 32, i) for i in range(1, 200)], "part string, good int, toxic int, fails int, copies long")
    got = {r.part: r for r in interactions.survivors(rows).collect()}
    for p in range(9):
        mine = [(i % 32, i) for i in range(1, 200) if i % 9 == p]
        want = [sum(n for m, n in mine if not m & s) for s in range(32)]
        assert got[f"p{p}"].kept == want == got[f"p{p}"].toxic and not any(got[f"p{p}"].good)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert entries.op11_filter_audit(spark, str(tmp_path)).collect() == []
