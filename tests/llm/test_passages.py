import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lockstep.llm import entries, passages as pg


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                    hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=False) if not g)).hexdigest()))
    return out


def corpus(rng):
    words = ["alpha", "bêta", "gamma", "漢字", "x"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(n))

    shared, line = prose(60), prose(15)
    texts = [None, "", "short", "z" * 399, "z" * 400, "y" * 1500, "ab" * 700, prose(100)]
    texts += [texts[-1], texts[-1] + "!", "?" + texts[-1][:700]]
    for i in range(30):
        texts.append(prose(rng.choice([5, 40])) + shared[: rng.choice([len(shared), 399, 401, 420, 450])] + prose(30))
        texts.append(line + prose(40) + line)
        texts.append(prose(20) + shared[rng.randrange(80):] + line)
    texts.append((prose(70) + "\n") * 3)
    return texts


def test_segments_are_the_windows_of_their_anchor():
    rng = random.Random(3)
    texts = [(t or "").encode() for t in corpus(rng)[:20]]
    together = pg.segments(texts)
    for i, t in enumerate(texts):
        alone = pg.segments([t])
        mine = together[0] == i
        for a, b in zip(alone[1:], together[1:], strict=True):
            assert np.array_equal(a, b[mine])
        starts = [o for a, b in zip(alone[1], alone[2], strict=True) for o in range(a, b - pg.LENGTH + 1)]
        assert starts == list(range(max(0, len(t) - pg.LENGTH + 1)))


@pytest.mark.parametrize("most", [1500, 5, 1])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(pg, "MOST_CONTENTS", most)
    monkeypatch.setattr(pg, "PART_BYTES", 700)
    texts = corpus(random.Random(4))
    rows = [(i if i != 9 else None, t, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, h int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entries.op7_passages(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for (i, _, _), want in zip(rows, brute(texts, 400), strict=True):
        assert got[i] == want, i


def test_strips_hold_every_window_once():
    rng = random.Random(9)
    for _ in range(200):
        n, gram = 30, 8
        place = rng.randrange(0, n - gram + 1)
        content = bytes(rng.randrange(256) for _ in range(place + n + rng.randrange(-min(place, 5), n - gram + 1)))
        content = content[:place + n]  # windows start at the content's first byte up to the anchor
        starts = [o for o in range(len(content) - n + 1) if o <= place <= o + n - gram]
        found = sorted(o + i for _, o, part in pg.strips(content, place, n, gram, 3) for i in range(len(part) - n + 1))
        assert found == starts


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert entries.op7_passages(spark, str(tmp_path)).count() == 0


def test_repeats_within_a_text_are_one_row(spark):
    line = "one line of some length that is written again and again, "
    texts = [line * 400, "x" * 3000, "once " + " ".join(str(i * 7919) for i in range(300))]
    rows = pg.keyed(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text")
    found = pg._segment_rows(rows, pg.LENGTH).collect()
    for t in texts[:2]:
        own = [r for r in found if r.n == len(t)]
        assert len(own) < 10
        spans = sorted((s, s + r.end - r.start) for r in own for s in r.starts)
        assert len(spans) > 300 and spans[0][0] == 0 and max(b for _, b in spans) == len(t)
        assert all(t[s:s + r.end - r.start] == t[r.start:r.end] for r in own for s in r.starts)
    gone = pg.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in gone] == [(len(t), k * len(t), k) for t, k in zip(texts, (1, 1, 0), strict=True)]


def test_a_block_in_all_windows_is_one_letter(monkeypatch):
    rng, n, gram, sizes = random.Random(5), 40, 9, []
    plain = pg.suffix_array
    monkeypatch.setattr(pg, "suffix_array", lambda text: sizes.append(len(text)) or plain(text))
    for _ in range(100):
        block = bytes(rng.randrange(256) for _ in range(n - gram))
        sides = {(bytes(rng.choice(b"ab") for _ in range(rng.randrange(gram + 1))), bytes(rng.choice(b"ab") for _ in range(rng.randrange(gram + 1)))) for _ in range(12)}
        contents = [a + block + b for a, b in sides]
        want = pg.repeated_windows(contents, n)
        assert pg.repeated_windows(contents, n, [len(a) for a, _ in sides], len(block)) == want
        done = len(sizes)
        assert pg.around_block(contents, n, [len(a) for a, _ in sides], len(block)) == want
        del sizes[done:]
    assert all(a + (n - gram - 1) * 2 <= b for a, b in zip(sizes[1::2], sizes[::2], strict=True))


@pytest.mark.parametrize("most", [1500, 2])
def test_repeated_passages_of_fifty_words_leave_the_last_column(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(pg, "MOST_CONTENTS", most)
    monkeypatch.setattr(pg, "PART_BYTES", 700)
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    passage = prose(51)
    assert 240 < len(passage) < 390
    texts = [prose(40) + " " + passage + " " + prose(200) for _ in range(6)] + [prose(60), None, "", *corpus(rng)[4:40]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = entries.op7_passages(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(len(texts)))
    assert all(passage in r.kept_text and passage[20:] not in r.text for r in got[:6])
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts, 400)
    ascii_only = [i for i, t in enumerate(texts) if (t or "").isascii()]
    short = brute(texts, entries.SHORT_PASSAGE)
    assert [hashlib.sha256(got[i].text.encode()).hexdigest() for i in ascii_only] == [short[i][3] for i in ascii_only]
    assert [len(got[i].text) for i in ascii_only] == [short[i][0] - short[i][1] for i in ascii_only]
