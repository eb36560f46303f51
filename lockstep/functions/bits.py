"""Numpy kernels over packed bit strings (MSB first), applied to one bounded chunk of packets at a time."""

from __future__ import annotations

import numpy as np

HISTORY_BITS = 80  # 63 bits of search register and 15 of descrambler memory, in whole bytes
ALL64 = (1 << 64) - 1

_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1)[:, 0]


def swap_pairs(data: np.ndarray) -> np.ndarray:
    """Exchange the bytes of each pair; an odd-length payload stays as it is."""
    if data.size % 2:
        return data
    return data.reshape(-1, 2)[:, ::-1].reshape(-1)


def reverse_each_byte(data: np.ndarray) -> np.ndarray:
    return _REVERSED[data]


def condition(payload: bytes, swap: bool, invert: bool) -> np.ndarray:
    """A payload's bytes after the transforms that look at nothing but the payload."""
    data = np.frombuffer(payload, dtype=np.uint8)
    if swap:
        data = swap_pairs(data)
    if invert:
        data = ~data
    return data


def concat_bits(parts: list[np.ndarray], n_bits: list[int]) -> tuple[np.ndarray, int]:
    """Join packets into one packed bit string; only the last byte may be partly used (the rest is zero)."""
    total = int(sum(n_bits))
    if not parts:
        return np.zeros(0, np.uint8), 0
    if all(n % 8 == 0 for n in n_bits):
        return np.concatenate([p[: n // 8] for p, n in zip(parts, n_bits)]), total
    bits = np.concatenate([np.unpackbits(p)[:n] for p, n in zip(parts, n_bits)])
    return np.packbits(bits), total


def head_bits(packed: np.ndarray, n_bits: int) -> str:
    return _as_text(np.unpackbits(packed[: HISTORY_BITS // 8 + 1])[: min(n_bits, HISTORY_BITS)])


def tail_bits(packed: np.ndarray, n_bits: int) -> str:
    first = max(0, n_bits - HISTORY_BITS)
    byte = first // 8
    return _as_text(np.unpackbits(packed[byte: (n_bits + 7) // 8])[first - 8 * byte: n_bits - 8 * byte])


def _as_text(bits: np.ndarray) -> str:
    return (bits + 48).tobytes().decode("ascii")


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), dtype=np.uint8) - 48


def descramble(packed: np.ndarray) -> np.ndarray:
    """Self-synchronising descrambler: every output bit is the input bit xor the inputs 14 and 15 bits before it."""
    one = np.zeros_like(packed)
    two = np.zeros_like(packed)
    one[1:] = packed[:-1]
    two[2:] = packed[:-2]
    back14 = (one >> 6) | (two << 2)
    back15 = (one >> 7) | (two << 1)
    return packed ^ back14 ^ back15


def with_history(packed: np.ndarray, n_bits: int, history: str, randomized: bool, lsb_first: bool = False) -> np.ndarray:
    """The bits as the search sees them, led by ``HISTORY_BITS`` bits of what came before (zeros at the stream's start)."""
    lead = from_text(history.rjust(HISTORY_BITS, "0")[-HISTORY_BITS:])
    plain = np.concatenate([np.packbits(lead), packed])
    if randomized:
        plain = descramble(plain)
    if lsb_first:
        plain = reverse_each_byte(plain)
    spare = (-n_bits) % 8
    if spare and plain.size:
        plain[-1] &= (0xFF << spare) & 0xFF
    return plain


def find_pattern(packed: np.ndarray, n_bits: int, pattern: int, mask: int) -> np.ndarray:
    """Positions (of the last bit) in ``with_history`` output where the last 64 bits under ``mask`` equal ``pattern``.

    Positions are relative to the first bit after the lead. A byte the mask covers whole is compared first, so the 64-bit
    test runs on few places.
    """
    pattern, mask = int(pattern) & ALL64, int(mask) & ALL64
    if pattern & ~mask & ALL64:
        return np.zeros(0, np.int64)  # a pattern bit outside the mask can never match
    data = np.concatenate([np.zeros(8, np.uint8), packed])
    size = data.size
    found = []
    for bit in range(8):
        places = _candidates(data, bit, pattern, mask)
        places = places[places >= 8]
        if not places.size:
            continue
        register = np.zeros(places.size, np.uint64)
        for back in range(8, 0, -1):
            register = (register << np.uint64(8)) | data[places - back].astype(np.uint64)
        register = register << np.uint64(bit + 1)
        register |= data[places].astype(np.uint64) >> np.uint64(7 - bit)
        hit = (register & np.uint64(mask)) == np.uint64(pattern)
        found.append((places[hit] - 8).astype(np.int64) * 8 + bit - HISTORY_BITS)
    if not found or not size:
        return np.zeros(0, np.int64)
    where = np.concatenate(found)
    where = where[(where >= 0) & (where < n_bits)]
    where.sort()
    return where


def _candidates(data: np.ndarray, bit: int, pattern: int, mask: int) -> np.ndarray:
    """Byte places worth the full test when the match ends at ``bit`` of that byte."""
    whole = [back for back in range(1, 8) if (mask >> ((back - 1) * 8 + bit + 1)) & 0xFF == 0xFF]
    if not whole:
        return np.arange(data.size)
    keep = None
    for back in whole[:2]:
        value = (pattern >> ((back - 1) * 8 + bit + 1)) & 0xFF
        same = np.zeros(data.size, bool)
        same[back:] = data[:-back] == value
        keep = same if keep is None else keep & same
    return np.flatnonzero(keep)


def word_values(plain: np.ndarray, n_bits: int, starts: np.ndarray, word_len: int) -> np.ndarray:
    """The part of each ``word_len``-bit word this piece holds, placed as in the whole word.

    ``plain`` has no lead. A word that reaches beyond the piece gets zeros there, so the pieces of a word add up to it.
    """
    pad = word_len // 8 + 2
    data = np.concatenate([np.zeros(pad, np.uint8), plain, np.zeros(pad + 1, np.uint8)])
    inside = (starts > -word_len) & (starts < n_bits)
    first = np.where(inside, starts, 0) + 8 * pad
    byte, shift = first >> 3, first & 7
    span = (word_len + 7 + 7) // 8
    value = np.zeros(starts.shape, np.uint64)
    for k in range(span):
        value = (value << np.uint64(8)) | data[byte + k].astype(np.uint64)
    drop = (8 * span - word_len - shift).astype(np.uint64)
    value = (value >> drop) & np.uint64((1 << word_len) - 1)
    return np.where(inside, value, np.uint64(0))
