"""Small bit streams for tests, and a plain bit-by-bit model of the lock to compare with."""

from __future__ import annotations

import numpy as np

PACKET_SCHEMA = "stream_id string, ord long, chunk long, n_bits long, base_ticks long, payload binary"
SECOND = 10_000_000


def pack(bits: str) -> bytes:
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()


def frame(word: int) -> str:
    return f"{word:04b}" + "0000" + "1001"


def stream(*words: int) -> str:
    return "1001" + "".join(frame(w) for w in words)


def split(bits: str, size: int, t0: float) -> list[tuple[str, float]]:
    return [(bits[i: i + size], t0 + i) for i in range(0, len(bits), size)]


def packets(spark, parts: dict[str, list[tuple[str, float]]], per_chunk: int = 3):
    rows = [(sid, i, i // per_chunk, len(b), round(t * SECOND), pack(b))
            for sid, items in parts.items() for i, (b, t) in enumerate(items)]
    return spark.createDataFrame(rows, PACKET_SCHEMA)


def streams(spark, ids: list[str], **changes):
    base = dict(pattern=9, mask=15, sync_len=4, bits_in_frame=12, words_in_frame=2, word_len=4, min_syncs=1, swap_bytes=False,
                inverted=False, randomized=False, bit_ticks=float(SECOND), rate_bps=0.0, period_ticks=15 * SECOND,
                use_rate_clock=False)
    base.update(changes)
    types = dict(pattern="long", mask="long", sync_len="int", bits_in_frame="int", words_in_frame="int", word_len="int",
                 min_syncs="int", swap_bytes="boolean", inverted="boolean", randomized="boolean", bit_ticks="double",
                 rate_bps="double", period_ticks="long", use_rate_clock="boolean")
    schema = "stream_id string, " + ", ".join(f"{k} {t}" for k, t in types.items())
    return spark.createDataFrame([(i, *[base[k] for k in types]) for i in ids], schema)


def serial_model(parts: list[tuple[str, float]], *, pattern: int, mask: int, sync_len: int, frame_bits: int, min_syncs: int,
                 word_len: int, words: int, period: float, rate_clock: bool = False, rate: float = 1.0, seconds_per_bit: float = 1.0):
    """Every bit in turn, one second each. Returns (samples, frames): samples are (t, lock %, missed, mean of word 0)."""
    seen = since = locked = total = missed = n = 0
    count = None
    register = 0
    out, frames, sums = [], [], 0.0
    since_words: list[int] = []
    history: list[int] = []
    seed = None
    pos = 0

    def close(gap: bool) -> None:
        nonlocal locked, total, n, sums
        out.append((start, 0.0 if gap else 100.0 * locked / total, missed, sums / n if n else 0.0))
        locked = total = n = 0
        sums = 0.0

    for bits, base in parts:
        if seed is None:
            seed = 0.0 if rate_clock else max(0.0, base)
            start = seed
        for i, ch in enumerate(bits):
            t = pos * seconds_per_bit if rate_clock else base + i * seconds_per_bit
            while start + period < t:
                if total:
                    close(False)
                else:
                    missed += int(period * rate / frame_bits)
                    count = None
                    close(True)
                start += period
            bit = int(ch)
            register = ((register << 1) | bit) & ((1 << 64) - 1)
            seen += 1
            since += 1
            history.append(bit)
            if since > frame_bits:
                missed += 1
                count = None
                since = 1
            in_lock = count is not None and count >= min_syncs
            match = seen >= sync_len and register & mask == pattern
            if match and (not in_lock or since == frame_bits):
                if since == frame_bits:
                    complete = count is not None and count + 1 >= min_syncs
                    count = 0 if count is None else count + 1
                    if complete:
                        body = history[-frame_bits:]
                        values = [int("".join(map(str, body[w * word_len:(w + 1) * word_len])), 2) for w in range(words - 1)]
                        frames.append((pos, values))
                        n += 1
                        sums += values[0] if values else 0
                else:
                    count = 1
                since = 0
            total += 1
            locked += in_lock
            pos += 1
    if n:
        close(False)
    return out, frames
