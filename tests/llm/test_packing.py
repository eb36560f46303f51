import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lockstep.llm import entries, packing
from lockstep.llm.tokens import PairTable

FILE = public_tokenizers.path("byte_bpe_50k.json")


def table():
    return PairTable(FILE, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "<|endoftext|>")


def test_ids_equal_the_tokenizer_on_odd_and_random_texts():
    rng = random.Random(5)
    alphabet = " \n\tab1.,'séß漢😀 　\x1c\x85s<|>tѐʼ"
    texts = ["", " ", "a<|endoftext|>b", "<|endoftext|>", "it's  I'll\n 're", "a\x00 b", "x" * 3000, " a", "a ", "\n a", "a \n b", "a \tb", "a\t \tb"]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(4000)]
    whole, ours = Tokenizer.from_file(FILE), table()
    for text, packed in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_plan_uses_every_length_and_wastes_little():
    rng = np.random.default_rng(1)
    for n, cap in ((1, 16), (40, 16), (3000, 64), (200_000, 1024)):
        histogram = np.bincount(np.minimum(cap, 1 + rng.gamma(1.3, cap / 3, n)).astype(int), minlength=cap + 1)
        plan = packing.plan_patterns(histogram)
        used = np.zeros(cap + 1, np.int64)
        for pattern, times in plan:
            assert sum(pattern) <= cap and times > 0
            np.add.at(used, list(pattern), times)
        assert (used == histogram).all()
        bound = max(-(-int((histogram * np.arange(cap + 1)).sum()) // cap), int(histogram[cap // 2 + 1:].sum()))
        assert sum(t for _, t in plan) <= bound * 1.02 + 2
    assert packing.plan_patterns(np.zeros(9, int)) == []


def test_query_pieces_are_whole_gapless_and_tight(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "a", "same text", "same text"] + [" ".join(rng.choices(["one", "Zwei", "три", "x1"], k=rng.choice([3, 40, 600, 2500]))) for _ in range(60)]
    rows = [(i if i != 7 else None, t, 5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = entries.op3_pack(spark, str(tmp_path)).toPandas()
    whole = Tokenizer.from_file(FILE)
    for doc_id, text, _ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        mine = got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id].sort_values("piece")
        assert mine.piece.tolist() == list(range(-(-len(ids) // 1024)))
        assert mine.length.tolist()[1:] == [1024] * (len(mine) - 1) and mine.length.sum() == len(ids)
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 3
    bare = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{bare}/documents.parquet")
    assert entries.op3_pack(spark, bare).count() == 0
