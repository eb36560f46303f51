import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lockstep.llm import entries, trees

FILE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = "<|endoftext|>"
RUNS = ["abcdefghij", "漢字仮名交文", "0123456789", "!?#$'", "  \n\t", "é ü", "'lvsret ", "a b", "aaaa", "🙂🙃é", "  x　", "s'l ", " "]
ODD = ["", " ", SPECIAL, SPECIAL * 3, f"a {SPECIAL} b", "<|endoftext", "don't we'll I've 'll'", "\x00", "﻿a", "é" * 30, "\r\n" * 40, " a" * 60]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def random_texts(rng, n):
    for _ in range(n):
        text = "".join("".join(rng.choices(rng.choice(RUNS), k=rng.choice([1, 3, 20, 90, 300]))) for _ in range(rng.randint(1, 6)))
        yield text + SPECIAL + text[:40] if rng.random() < 0.1 else text


@pytest.mark.parametrize("leaf", [1, 5, 16, 64])
def test_joined_halves_equal_the_library(library, monkeypatch, leaf):
    monkeypatch.setattr(trees, "LEAF_CHARS", leaf)
    coder = trees.TreeCoder(FILE, RANKS, public_tokenizers.PATTERN, SPECIAL)
    texts = ODD + list(random_texts(random.Random(leaf), 250))
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False), repr(text)


def test_runs_without_a_break_are_joined_by_small_windows(library, monkeypatch):
    coder = trees.TreeCoder(FILE, RANKS, public_tokenizers.PATTERN, SPECIAL)
    rng, longest = random.Random(8), []
    encoded = coder._encoded
    monkeypatch.setattr(coder, "_encoded", lambda text: longest.append(len(text)) or encoded(text))
    for letters in ("abcdefgh", "漢字仮名", "01234", "#!?", "  \t"):
        text = "".join(rng.choices(letters, k=60_000))
        assert coder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(longest) < 600


def test_decodes_ids_that_form_no_character(library):
    coder = trees.TreeCoder(FILE, RANKS, public_tokenizers.PATTERN, SPECIAL)
    for ids in ([128, 129, 50256, 200], [447], [447, 247, 10545], []):
        assert coder.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_long_texts_over_several_tasks(spark, library, monkeypatch, tmp_path):
    monkeypatch.setattr(trees, "PART_CHARS", 50)
    texts = ODD + list(random_texts(random.Random(4), 40)) + [None]
    rows = [(i if i % 7 else None, t, "c") for i, t in enumerate(texts)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, packed string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entries.op12_byte_pairs(spark, str(tmp_path)).collect())

    def want(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return (str(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    assert got == sorted(want(i, t) for i, t, _ in rows)


def test_no_documents_and_clashing_names(spark):
    coded = trees.encode_decode(spark.createDataFrame([(1, "a b", 2)], "packed int, text string, decoded int"), FILE, RANKS, public_tokenizers.PATTERN,
                                SPECIAL, keep=("packed", "text"))
    assert coded.columns == ["packed", "text", "packed", "decoded"] and coded.collect()[0][3] == "a b"
    none = spark.createDataFrame([], "doc_id long, text string")
    assert trees.encode_decode(none, FILE, RANKS, public_tokenizers.PATTERN, SPECIAL).collect() == []
