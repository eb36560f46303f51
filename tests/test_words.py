from collections import Counter

import numpy as np
import pyarrow as pa
from bitstreams import PACKET_SCHEMA

from lockstep.functions import words
from lockstep.operators import bits


def brute(text: str, length: int, min_reps: int) -> list[tuple]:
    """``word, period, hits, on_grid`` by the rule, word for word."""
    places: dict[int, list[int]] = {}
    for i in range(len(text) - length + 1):
        places.setdefault(int(text[i: i + length], 2), []).append(i)
    out = []
    for word, at in places.items():
        spaces = [b - a for a, b in zip(at, at[1:])]
        if len(at) < min_reps or not spaces:
            continue
        period, reps = max(Counter(spaces).items(), key=lambda x: (x[1], -spaces.index(x[0])))
        if reps >= min_reps - 1 and period > length:
            out.append((word, period, len(at), max(Counter(p % period for p in at).values())))
    return sorted(out)


def signal(rng, frames: int) -> str:
    """Frames with idle fill, ties between distances, and words whose fill is not on their grid."""
    out = ""
    for i in range(frames):
        out += "1111000010100101" + "".join(rng.choice(list("01"), 20)) + "0" * int(rng.choice([40, 40, 7])) + ("01" * 30 if i % 5 == 0 else "1" * 12)
    return out + "0" * (-len(out) % 8)


def test_discovery_in_parts_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = {"a": signal(rng, 90), "b": signal(rng, 40), "c": "1" * 8}
    rows = []
    for name, text in texts.items():
        cuts = sorted({0, len(text), *(int(c) for c in rng.integers(1, max(2, len(text)), 12))})
        for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
            rows.append((name, i, i // 3, y - x, 0, np.packbits(np.frombuffer(text[x:y].encode(), np.uint8) - 48).tobytes()))
    for length, reps in ((16, 6), (12, 4), (33, 3)):
        found = bits.discover_sync(spark.createDataFrame(rows, PACKET_SCHEMA), length, reps, part_bits=1500).collect()
        for name, text in texts.items():
            own = sorted((r for r in found if r.stream_id == name), key=lambda r: r.place)
            assert sorted((r.word, r.period, r.hits, r.on_grid) for r in own) == brute(text, length, reps)
            assert [r.place for r in own] == list(range(1, len(own) + 1))
            assert [(r.on_grid, r.word, r.period) for r in own] == sorted(((r.on_grid, r.word, r.period) for r in own), reverse=True)
        assert {r.stream_id for r in found} == {"a", "b"}


def test_a_chunk_gives_out_a_row_per_part_and_few_bytes_a_bit():
    """It gave out a row per run of a word: nearly one per bit."""
    data = np.random.default_rng(5).integers(0, 256, 20_000, np.uint8).tobytes() + bytes(20_000)
    table = pa.record_batch({"stream_id": ["s"], "ord": [0], "chunk": [0], "n_bits": [8 * len(data)], "payload": [data], "chunk_base": [0], "history": [""], "parts": [7]})
    rows = pa.Table.from_batches(list(bits._word_pieces(32)(iter([table]))))
    assert rows.num_rows == 7
    assert sum(len(v) for c in bits._PIECE_COLUMNS for v in rows.column(c).to_pylist()) < 17 * 8 * 20_000 + 1000  # the fill is one entry
    assert sum(int(np.frombuffer(v, np.uint32).sum()) for v in rows.column("run_n").to_pylist()) > 8 * 20_000 - 64


def test_slices_of_a_chunk_give_every_word_once():
    text = np.random.default_rng(6).integers(0, 2, 1001).astype(np.uint8)
    lead = np.array([1, 0, 1, 1, 0], np.uint8)
    whole = "".join(map(str, [*lead[-4:], *text]))
    want = [(i - 4, int(whole[i: i + 5], 2)) for i in range(len(whole) - 4)]
    got = [(begin + i, int(w)) for begin, b in words.slices(np.packbits(text), text.size, lead, 5, 64) for i, w in enumerate(words.words_at(b, 5))]
    assert got == want


def test_neighbouring_words_leave_a_chunk_together():
    """Each start of a word left by itself: 32 bytes and more for a byte of payload."""
    rng = np.random.default_rng(8)
    known = [bytes(rng.choice(list(b"abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9))).tolist()) for _ in range(400)]
    data = b" ".join(known[i] for i in (rng.zipf(1.3, 30_000) % 400))
    table = pa.record_batch({"stream_id": ["s"], "ord": [0], "chunk": [0], "n_bits": [8 * len(data)], "payload": [data], "chunk_base": [0], "history": [""], "parts": [3]})
    turns = [pa.Table.from_batches(list(bits._word_pieces(32, None, t, 3)(iter([table])))) for t in range(3)]
    assert [t.column("part").to_pylist() for t in turns] == [[0], [1], [2]]
    assert sum(len(v) for t in turns for c in bits._PIECE_COLUMNS for v in t.column(c).to_pylist()) < 5 * len(data)


def test_stretches_hold_every_word_once():
    rng = np.random.default_rng(9)
    for length in (5, 16, 32, 33, 45, 58, 64):
        text = np.concatenate([rng.integers(0, 2, 700), np.tile(rng.integers(0, 2, 11), 30), np.zeros(200, int), np.tile([0, 1], 90)]).astype(np.uint8)
        keys, _, counts, starts, run_at, run_step, run_n, cuts, start_cuts, run_cuts = words.word_starts(text, length, 4, None)
        n, step = np.ones(starts.size, int), np.zeros(starts.size, int)
        at = run_at + np.repeat(start_cuts[:-1], np.diff(run_cuts))
        n[at], step[at] = run_n, run_step
        assert run_n.sum() > 100 and counts.sum() == starts.size
        got = []
        order = np.argsort(starts, kind="stable")
        for w, s, at, apart, times in words.unfolded(keys, np.repeat(np.arange(keys.size), counts)[order], starts[order], n[order], step[order], length):
            many, each = np.ones(s.size, int), np.zeros(s.size, int)
            many[at], each[at] = times, apart
            got += [(int(first) + i * int(d), int(word)) for word, first, k, d in zip(words.plain_words(w, length).astype(np.uint64), s, many, each) for i in range(k)]
        assert sorted(got) == list(enumerate(words.words_at(text, length).tolist()))


def test_fill_of_any_period_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    text = ""
    for i in range(60):
        text += "".join(rng.choice(list("01"), int(rng.integers(1, 40)))) + "1101000110100011" * (3 if i % 2 else 1)
        text += ("".join(rng.choice(list("01"), int(rng.integers(1, 20)))) * 30)[: int(rng.integers(20, 150))] if i % 4 else "001011" * 20
        text += "0" * (-len(text) % 300)
    text += "0" * (-len(text) % 8)
    rows = [("a", i, i // 2, min(1000, len(text) - x), 0, np.packbits(np.frombuffer(text[x: x + 1000].encode(), np.uint8) - 48).tobytes())
            for i, x in enumerate(range(0, len(text), 1000))]
    for length in (8, 16, 32):
        found = bits.discover_sync(spark.createDataFrame(rows, PACKET_SCHEMA), length, 6, part_bits=2000).collect()
        assert sorted((r.word, r.period, r.hits, r.on_grid) for r in found) == brute(text, length, 6)
        assert found


def test_shuffled_files_go_with_their_query(spark):
    from lockstep.session import brief_shuffles

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with brief_shuffles(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
