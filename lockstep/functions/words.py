"""Numpy kernels for words at every bit of a chunk: where each starts, and which spacing its starts share.

Neighbouring words share most of their bits. So a word is dealt out by its least piece (of about half its length, in an order that spares common
pieces), and neighbouring words with the same least piece leave a chunk together, as one *stretch*: the bits they span and one start. Equal
stretches are sorted together; those of idle fill, which come back within half a word, are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_FACTOR = 0x9E3779B97F4A7C15
_SPREAD = 0xD6E8FEB86659FD93
#: Bits whose words are sorted at a time, whatever a chunk holds.
SLICE_BITS = 1 << 22
#: Starts of one spacing that make one entry.
_LONG_RUN = 4
#: A piece that begins at a larger share of all bits is common.
COMMON = 0.001
#: Buckets of a part, and starts that are unfolded at a time.
BUCKETS, _UNFOLDED = 64, 1 << 20
#: Bits of a piece that are looked up in the table of common pieces; bits of a place in a slice.
_LOOKED_UP, _PLACE = 16, 24


def _scrambled(words: np.ndarray, length: int, factor: int) -> np.ndarray:
    mask = (1 << length) - 1
    return words * np.uint64(factor & mask) & np.uint64(mask)


def plain_words(words: np.ndarray, length: int) -> np.ndarray:
    return _scrambled(words, length, pow(_FACTOR, -1, 1 << length)).astype(np.int64)


def words_at(bits: np.ndarray, length: int) -> np.ndarray:
    """The ``length``-bit word that starts at each bit, by doubling."""
    out, size = bits.astype(np.uint64), 1
    for digit in bin(length)[3:]:
        out = (out[:-size] << np.uint64(size)) | out[size:]
        size *= 2
        if digit == "1":
            out = (out[:-1] << np.uint64(1)) | bits[size:]
            size += 1
    return out


def _sorted_by_word(words: np.ndarray, length: int) -> np.ndarray:
    """The order by word, then by place."""
    shift = max(1, words.size.bit_length())
    if length + shift > 64:
        return np.argsort(words, kind="stable")
    key = (words << np.uint64(shift)) | np.arange(words.size, dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << shift) - 1)).astype(np.int64)


def squeezed(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers packed for the way to another task: their bytes place by place (of the steps between them, if ``rising``), compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    raw = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def released(packed: bytes, kind: type, rising: bool = False) -> np.ndarray:
    raw = pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), "zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if rising else values


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def piece_length(length: int) -> int:
    """Bits of the pieces of a word: half of it or 16, but so many that a stretch and the number of its words fit into 64 bits."""
    return min(length, max(min(16, max(1, length // 2)), 2 * length - 58))


def count_pieces(data: np.ndarray, length: int, counts: np.ndarray) -> None:
    """Add how often each piece (its first 16 bits) begins at a bit of ``data`` (bytes) to ``counts``."""
    size = min(piece_length(length), _LOOKED_UP)
    for begin in range(0, data.size - 2, 1 << 20):
        near = data[begin: begin + (1 << 20) + 2].astype(np.uint32)
        three = (near[:-2] << 16) | (near[1:-1] << 8) | near[2:]
        for bit in range(8):
            counts += np.bincount((three >> (24 - bit - size)) & ((1 << size) - 1), minlength=counts.size)


def commonness(pieces: list[tuple[int, int]], total: int, length: int) -> np.ndarray:
    """Levels of the pieces that begin at more than ``COMMON`` of ``total`` bits, one for each doubling; 0 for all others."""
    levels = np.zeros(1 << min(piece_length(length), _LOOKED_UP), np.uint8)
    for piece, n in pieces:
        levels[piece] = max(0, min(15, int(np.floor(np.log2(n / (COMMON * total)))) + 1))
    return levels


def stretches(bits: np.ndarray, length: int, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``keys, starts, hashes`` of the stretches: the bits of its words behind their number less one, its first start, and a 32-bit hash of the
    least piece (the first of them, if there are more), which depends on the word alone."""
    size = piece_length(length)
    width, window = 2 * length - size, length - size + 1
    padded = words_at(np.concatenate([bits, np.zeros(width, bits.dtype)]), size)
    pieces = padded[:bits.size - size + 1]
    if window == 1:
        return pieces, np.arange(pieces.size), _hash(pieces)
    rank = _scrambled(pieces, size, _FACTOR)
    if levels is not None:
        rank |= levels[pieces >> np.uint64(max(0, size - _LOOKED_UP))].astype(np.uint64) << np.uint64(size)
    least = ((rank >> np.uint64(max(0, size + 4 + _PLACE - 64))) << np.uint64(_PLACE)) | np.arange(rank.size, dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < window:
        least = np.minimum(least[:least.size - (window - span)], least[window - span:])
    place = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = _firsts(place)
    n = np.diff(np.r_[first, place.size])
    value = np.zeros(first.size, np.uint64)
    whole, rest = divmod(width, size)
    for i in range(whole):
        value = (value << np.uint64(size)) | padded[first + i * size]
    if rest:
        value = (value << np.uint64(rest)) | (padded[first + whole * size] >> np.uint64(size - rest))
    value >>= (width - length + 1 - n).astype(np.uint64)
    return ((n - 1).astype(np.uint64) << np.uint64(width)) | value, first, _hash(pieces[place[first]])


def _hash(pieces: np.ndarray) -> np.ndarray:
    return ((pieces + np.uint64(1)) * np.uint64(_SPREAD)) >> np.uint64(32)


def word_starts(bits: np.ndarray, length: int, parts: int, levels: np.ndarray | None = None, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, ...]:
    """``keys, buckets, counts, starts, run_at, run_step, run_n, key_cuts, start_cuts, run_cuts`` of one slice, cut into ``parts`` by word.

    ``counts`` are entries per stretch (``keys``), in whose order ``starts`` are; entry ``run_at`` (counted in its part) stands for ``run_n``
    starts ``run_step`` apart. That is at most half a word: a word that came twice within such a step would make the step shorter.
    Of ``turns`` only the parts of this ``turn`` are made, every so many-th.
    """
    keys, starts, hashes = stretches(bits, length, levels)
    place = hashes * np.uint64(parts)
    part, bucket = (place >> np.uint64(32)).astype(np.int64), ((place & np.uint64(0xFFFFFFFF)) * np.uint64(BUCKETS)) >> np.uint64(32)
    dealt = part * BUCKETS + bucket.astype(np.int64)
    if turns > 1:
        mine = part % turns == turn
        keys, starts, dealt = keys[mine], starts[mine], dealt[mine]
    order = np.lexsort((keys, dealt))
    keys, starts, dealt = keys[order], starts[order], dealt[order]
    fresh = np.r_[True, keys[1:] != keys[:-1]][:keys.size]
    step = np.where(fresh, -1, np.r_[0, np.diff(starts)][:keys.size])
    first = np.flatnonzero(fresh | np.r_[True, step[1:] != step[:-1]][:keys.size])
    n = np.diff(np.r_[first, keys.size])
    long = (n >= _LONG_RUN) & (step[first] > 0) & (step[first] <= length // 2)
    kept = np.repeat(~long, n)
    kept[first] = True
    entry = np.cumsum(kept) - 1
    run_at, run_step, run_n = entry[first[long]], step[first[long]], n[long]
    keys, starts, dealt = keys[kept], starts[kept], dealt[kept]
    at = _firsts(keys)[:keys.size]
    unique, counts, dealt = keys[at], np.diff(np.r_[at, keys.size]), dealt[at]
    key_cuts = np.searchsorted(dealt, np.arange(parts + 1) * BUCKETS)
    start_cuts = np.r_[at, keys.size][key_cuts]
    run_cuts = np.searchsorted(run_at, start_cuts)
    run_at = run_at - np.repeat(start_cuts[:-1], np.diff(run_cuts))
    return unique, dealt % BUCKETS, counts, starts, run_at, run_step, run_n, key_cuts, start_cuts, run_cuts


def unfolded(keys: np.ndarray, key_of: np.ndarray, starts: np.ndarray, n: np.ndarray, step: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``words, starts, run_at, run_step, run_n`` of stretches in the order of the stream (``key_of``: places in ``keys``), some words after others."""
    size = piece_length(length)
    width = 2 * length - size
    many = (keys >> np.uint64(width)).astype(np.int64) + 1 if size < length else np.ones(keys.size, np.int64)
    i, most = np.arange(length - size + 1), (1 << length) - 1
    here = i < many[:, None]
    table = _scrambled((keys[:, None] >> np.maximum(many[:, None] - 1 - i, 0).astype(np.uint64)) & np.uint64(most), length, _FACTOR)
    rounds = max(1, -(-int(many[key_of].sum()) // _UNFOLDED))
    kind = ((table * np.uint64(_SPREAD)) >> np.uint64(40)) % np.uint64(rounds) if rounds > 1 else None
    for k in range(rounds):
        wanted = here if kind is None else here & (kind == k)
        found = []
        for begin in range(0, key_of.size, 1 << 18):
            of = key_of[begin: begin + (1 << 18)]
            row, column = np.nonzero(wanted[of])
            at = row + begin
            found.append((table[of[row], column], starts[at] + column, n[at], step[at]))
        words, first, times, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        runs = np.flatnonzero(times > 1)
        yield words, first, runs, apart[runs], times[runs]


def slices(packed: np.ndarray, n_bits: int, lead: np.ndarray, length: int, slice_bits: int = SLICE_BITS) -> Iterator[tuple[int, np.ndarray]]:
    """The bits in slices, each led by the ``length - 1`` bits before it, with the place of its first bit. ``lead`` is what is before the chunk."""
    before = lead[max(0, lead.size - length + 1):]
    for begin in range(0, n_bits, slice_bits):
        own = np.unpackbits(packed[begin // 8: (begin + slice_bits) // 8])[: n_bits - begin]
        bits = np.concatenate([before, own])
        if bits.size >= length:
            yield begin - before.size, bits
        before = bits[max(0, bits.size - length + 1):]


def _tally(group: np.ndarray, value: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Groups, values and summed weights of the distinct (group, value), in their order; the key of each row, and the bits a value takes in it.

    A part has some 2**22 words at most, so that a value may have 41 bits.
    """
    shift = max(1, int(value.max()).bit_length())
    key = (group << shift) | value
    if weight is None:
        ordered = np.sort(key)
        at = _firsts(ordered)
        sums = np.diff(np.r_[at, ordered.size])
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        at = _firsts(ordered)
        sums = np.add.reduceat(weight[order], at)
    found = ordered[at]
    return found >> shift, found & ((1 << shift) - 1), sums, key, shift


def spaced_words(words: np.ndarray, starts: np.ndarray, run_at: np.ndarray, run_step: np.ndarray, run_n: np.ndarray, length: int,
                 min_reps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word, period, hits, on_grid`` of the words with ``min_reps`` starts and more, most of them one distance of more than ``length`` apart.

    Entries (``words``, ``starts``) are in the order of the stream. Of distances that are as common the one seen first counts.
    """
    none = np.zeros(0, np.int64)
    n, step = np.ones(words.size, np.int64), np.zeros(words.size, np.int64)
    n[run_at], step[run_at] = run_n, run_step
    order = _sorted_by_word(words, length)
    words, starts, n, step = words[order], starts[order], n[order], step[order]
    at = _firsts(words) if words.size else none
    if not at.size:
        return none, none, none, none
    total = np.add.reduceat(n, at)
    often = np.repeat(total >= min_reps, np.diff(np.r_[at, words.size]))
    words, starts, n, step, total = words[often], starts[often], n[often], step[often], total[total >= min_reps]
    if not words.size:
        return none, none, none, none
    fresh = np.r_[True, words[1:] != words[:-1]]
    group = np.cumsum(fresh) - 1
    back = starts - np.r_[0, (starts + (n - 1) * step)[:-1]]
    inner = n > 1
    followed, seen = np.r_[group[~fresh], group[inner]], np.r_[starts[~fresh], (starts + step)[inner]]
    weight = np.r_[np.ones(np.count_nonzero(~fresh), np.int64), n[inner] - 1] if inner.any() else None
    of, distance, reps, key, shift = _tally(followed, np.r_[back[~fresh], step[inner]], weight)
    most = np.zeros(total.size, np.int64)
    np.maximum.at(most, of, reps)
    best = (reps == most[of]) & (reps >= min_reps - 1)
    of, distance = of[best], distance[best]
    if (of[1:] == of[:-1]).any():
        wanted = (of << shift) | distance
        place = np.minimum(np.searchsorted(wanted, key), wanted.size - 1)
        hit = wanted[place] == key
        first = np.full(wanted.size, np.iinfo(np.int64).max)
        np.minimum.at(first, place[hit], seen[hit])
        early = np.lexsort((first, of))
        of, distance = of[early], distance[early]
        one = _firsts(of)
        of, distance = of[one], distance[one]
    of, distance = of[distance > length], distance[distance > length]
    if not of.size:
        return none, none, none, none
    period = np.zeros(total.size, np.int64)
    period[of] = distance
    here = period[group] > 0
    group, starts, n, step = group[here], starts[here], n[here], step[here]
    each = period[group]
    # the starts of an entry come back to the same residues after ``cycle`` of them
    cycle = each // np.gcd(step, each)
    listed = np.minimum(n, cycle)
    if (n > 1).any():
        i = np.arange(int(listed.sum())) - np.repeat(np.cumsum(listed) - listed, listed)
        group, starts, n, step, cycle, each = (np.repeat(x, listed) for x in (group, starts, n, step, cycle, each))
        on, residue, reps, _, _ = _tally(group, (starts + i * step) % each, (n - i + cycle - 1) // cycle)
    else:
        on, residue, reps, _, _ = _tally(group, starts % each, None)
    grid = np.zeros(total.size, np.int64)
    np.maximum.at(grid, on, reps)
    chosen = np.zeros(total.size, bool)
    chosen[of] = True
    return plain_words(words[fresh][chosen], length), period[chosen], total[chosen], grid[chosen]
