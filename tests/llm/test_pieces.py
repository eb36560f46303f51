import hashlib
import random

import public_tokenizers
import sentencepiece

from lockstep.llm import entries, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "\n", " \n ", "a\n b", "\t\tx", "▁a▁▁b", "<s>", "</s> x", "<0x0A>", "<unk> <pad>",
       "naïve 漢字 😀 é", " a b", "​", "a\x00b", "　x", "word " * 500, "x" * 5000, " " * 40 + "a", "﻿", "a\r\nb", "⁇ ⁇"]


def test_equals_the_library_on_odd_and_random_texts():
    rng = random.Random(3)
    alphabet = " \n\tabcde.,é漢😀▁ <>/s0x"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    chunks = pieces.ChunkTable(MODEL)
    for text, ids in zip(texts, chunks.encode(texts), strict=True):
        want = library.encode(text, add_eos=True)
        assert ids == want, repr(text)
        assert chunks.decode([ids])[0] == library.decode(want), repr(text)


def test_decodes_byte_pieces_that_form_no_character():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    chunks = pieces.ChunkTable(MODEL)
    for ids in ([131, 200, 2], [29871, 255, 65], [0, 5, 2], []):
        assert chunks.decode([ids])[0] == library.decode(ids)


def test_small_table_gives_the_same(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 3)
    chunks = pieces.ChunkTable(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _ in range(3):
        assert chunks.encode(ODD) == [library.encode(t, add_eos=True) for t in ODD]


def test_query_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entries.op9_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {r.n_tokens for r in got if r.doc_id is None or r.doc_id == 2} == {1}
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.decoded_sha256 == empty) == (r.n_tokens == 1) for r in got)
    bare = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{bare}/documents.parquet")
    assert entries.op9_sentencepiece(spark, bare).count() == 0
