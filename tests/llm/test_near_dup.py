import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lockstep.llm import entries, near_dup as nd
from lockstep.llm.chars import WORD, Words
from lockstep.llm.components import components


def bag(text):
    words = Words([text])
    words.only(words.kind == WORD)
    return Counter(words.shingles(5)[1].tolist())


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_registers_estimate_the_weighted_index_without_bias():
    rng = np.random.default_rng(2)
    shingle = rng.integers(0, 2**63, 60, dtype=np.uint64)
    wa, wb = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    wa[:10], wb[50:] = 0, 0
    text = np.repeat([0, 1], 60)
    w = np.concatenate([wa, wb])
    keep = w > 0
    first = nd.signatures(text[keep], np.concatenate([shingle, shingle])[keep], w[keep], 2, 20_000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert (first[0] == first[1]).mean() == pytest.approx(want, abs=0.015)
    assert first[0].mean() == pytest.approx(20_000 / wa.sum(), rel=0.05)  # rate one per cell


def test_batches_do_not_matter():
    texts = ["a b c d e f g", "", "x", "a b c d e f g " * 30, "!!"]
    whole = nd.signatures(*nd.bags(texts)[:3], len(texts))
    for t, row in zip(texts, whole, strict=True):
        assert np.array_equal(nd.signatures(*nd.bags([t])[:3], 1)[0], row)


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(3).write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("block", [4096, 3])
def test_query_equals_brute_force_components(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(8):
        base = rng.choices(words, k=rng.choice([30, 80, 200]))
        for _ in range(7):
            changed = base[:]
            for _ in range(rng.choice([0, 1, 2, 4])):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            texts.append(rng.choice([" ", "  ", ", "]).join(changed))
    chain = rng.choices(words, k=120)
    for i in range(10):  # neighbours are alike, the ends are not
        chain = chain[3:] + rng.choices(words, k=3)
        texts.append(" ".join(chain))
    texts += ["", None, "!!", "!!", "?", "one two", "One Two.", "one two three", "the same line again " * 40, "the same line again " * 45, "the same line again " * 90]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], "x")]
    write(spark, tmp_path, rows)
    contents = {}
    for i, t, _ in rows:
        contents.setdefault(nd.bags([t or ""])[3][0], (bag(t or ""), []))[1].append(i)
    parent = {c: c for c in contents}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a, b in combinations(contents, 2):
        if contents[a][0] and contents[b][0] and jaccard(contents[a][0], contents[b][0]) >= 0.8:
            parent[find(a)] = find(b)
    groups = {}
    for c, (_, ids) in contents.items():
        groups.setdefault(find(c), []).extend(ids)
    want = sorted((-1 if i is None else i, min(x for x in g if x is not None), len(g)) for g in groups.values() for i in g)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.class_size) for r in entries.op6_near_dup(spark, str(tmp_path)).collect())
    assert got == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = nd.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(x for x in g if x is not None) for g in groups.values())


def test_components_by_rounds_and_by_one_task(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r.node: r.root for r in components(df).collect()}
    assert one == {r.node: r.root for r in components(df, 0).collect()} and one[40] == 0 and one[0] == 0
    assert components(df.limit(0)).count() == 0


def test_empty_and_nothing_alike(spark, tmp_path):
    write(spark, f"{tmp_path}/a", [])
    assert entries.op6_near_dup(spark, f"{tmp_path}/a").count() == 0
    write(spark, f"{tmp_path}/b", [(1, "a b c d e f", "x"), (2, "g h i j k l", "x"), (None, None, "x")])
    assert {(r.doc_id, r.class_id) for r in entries.op6_near_dup(spark, f"{tmp_path}/b").collect()} == {(1, 1), (2, 2), (None, None)}


def test_blocks_give_out_fewer_links_than_contents():
    """Forty texts in one family: all pairs are similar, thirty-nine links leave the block."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:200 + i]) for i in range(20)]
    owner, shingle, weight, digests = nd.bags(texts)
    marks = nd.register_marks(nd.signatures(owner, shingle, weight, len(texts)))
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    rows = [dict(content=d, marks=m, size=int(weight[a:b].sum()), bands=[7, i], own=0, root=d, bag=np.sort(np.repeat(shingle[a:b] >> np.uint64(32), weight[a:b])).astype("<u4").tobytes())
            for i, (d, m, a, b) in enumerate(zip(digests, marks, cuts[:-1], cuts[1:], strict=True))]
    links = nd.Block(rows, 7).links(0, 0)
    assert len(links) == len(texts) - 1 and len({x for link in links for x in link}) == len(texts)
    assert nd.Block([{**r, "bands": [1, 7]} for r in rows], 7).links(0, 0) == []  # all pairs share an earlier bucket
