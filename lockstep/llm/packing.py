"""Pattern packing: which pieces of documents share a sequence, decided on the histogram of lengths.

Documents longer than a sequence are cut into full pieces, the first one shorter. What is left to pack is a histogram over at most
``capacity`` lengths, whatever the corpus' size. Patterns of one to three lengths that fill a sequence are enumerated, their repeat counts
are fitted to the histogram by non-negative least squares, rounded to what the histogram still holds, and fitted again on the rest; the
last rest is packed best-fit, longest first. Only the histogram comes to the driver. A piece finds its place by its rank among the pieces
of its length: ranks are counted inside each task and shifted by the counts of the tasks before, so no length (a third of the rows may
share one) is brought together.

Edge cases: a null text is the empty text, whose only id is the end id; repeated rows are packed as rows of their own; an empty table
gives no rows. Columns other than the kept ones do not pass.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.common import materialize, prepared, strings, with_fields
from lockstep.llm.tokens import PairTable

#: Rounds of fitting and rounding before the rest is packed best-fit.
FIT_ROUNDS = 2
#: Triples offered to the fit, drawn evenly from all: with more, repeats fall below one half and rounding loses them.
TRIPLES = 12_000
#: Gradient steps of one least-squares fit.
FIT_STEPS = 400


def token_pieces(df: DataFrame, make_table, end_id: int, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32``, and ``task, rank``: its number among the task's pieces of its length."""
    prepared(df.sparkSession)
    picked = df.select(key, text)
    schema = with_fields(picked.select(key), "piece int, start long, length long, ids_crc32 long, task int, rank long")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task, seen = make_table(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, packed in enumerate(table.encode(strings(batch.column(1)))):
                ids = packed + end if sys.byteorder == "little" else np.frombuffer(packed, "u4").astype("<u4").tobytes() + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(pairwise(cuts)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a:4 * b]))
                    rank.append(seen[b - a])
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                names=schema.names)

    return picked.mapInArrow(run, schema)


def full_patterns(histogram: np.ndarray) -> np.ndarray:
    """Patterns of two (all) or three (evenly drawn) present lengths that fill the capacity, as rows padded with zero."""
    capacity = len(histogram) - 1
    there = np.flatnonzero(histogram[1:capacity]) + 1
    present = np.zeros(capacity + 1, bool)
    present[there] = True
    a, b = (x.ravel() for x in np.meshgrid(there, there, indexing="ij"))
    pairs = a[(a + b == capacity) & (a >= b)]
    out = [np.stack([pairs, capacity - pairs, np.zeros_like(pairs)], 1)]
    keep = (a >= b) & (a + b < capacity)
    a, b = a[keep], b[keep]
    c = capacity - a - b
    keep = (c <= b) & present[c]
    triples = np.stack([a[keep], b[keep], c[keep]], 1)
    out.append(triples[np.random.default_rng(0).permutation(len(triples))[:TRIPLES]])
    return np.concatenate(out)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares: repeats ``x >= 0`` with ``sum_p x_p pattern_p`` nearest to the histogram (accelerated projected steps)."""
    capacity, width = len(histogram) - 1, patterns.shape[1]
    flat = patterns.ravel()

    def made(x: np.ndarray) -> np.ndarray:
        total = np.bincount(flat, np.repeat(x, width), capacity + 1)
        total[0] = 0
        return total

    def gains(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[patterns].sum(1)

    v = np.ones(len(patterns))  # largest eigenvalue of the normal matrix bounds the step
    for _ in range(30):
        v = gains(made(v))
        norm = np.linalg.norm(v)
        v = v / norm
    x = y = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y + gains(histogram - made(y)) / (1.02 * norm))
        grown = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        y, x, momentum = nxt + (momentum - 1) / grown * (nxt - x), nxt, grown
    return x


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: patterns with their repeats. Bins of the same free room are handled together."""
    capacity = len(histogram) - 1
    room: dict[int, list[list]] = {}  # free room -> [[pattern, bins], ...]
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                free = capacity
                room.setdefault(free, []).append([(), left])
            pattern, bins = room[free].pop()
            fits = min(free // length, left)
            used = min(bins, left // fits)
            if used < bins:
                room[free].append([pattern, bins - used])
            if not room[free]:
                del room[free]
            room.setdefault(free - fits * length, []).append([pattern + (length,) * fits, used])
            left -= fits * used
    return [(tuple(p), n) for groups in room.values() for p, n in groups if p and n]


def plan_patterns(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that use every length exactly as often as the histogram says."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for _ in range(FIT_ROUNDS):
        patterns = full_patterns(left)
        if not len(patterns):
            break
        repeats = np.rint(fit_repeats(patterns, left.astype(float))).astype(np.int64)
        before = len(plan)
        for p in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)]:
            lengths, times = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
            n = int(min(repeats[p], (left[lengths] // times).min()))
            if n:
                left[lengths] -= n * times
                plan.append((tuple(int(x) for x in patterns[p] if x), n))
        if len(plan) == before:
            break
    return plan + best_fit(left)


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For every run of ranks of a length: the length, its first rank, its first sequence and the offset. Bounded by the plan."""
    taken = [0] * (capacity + 1)
    rows, first = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], first, offset))
            taken[length] += n
            offset += length
        first += n
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have ``length, task, rank``; the two counters are dropped."""
    pieces = materialize(pieces)  # read twice, and ranks belong to this run's tasks
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[row.length] = row.n
    lengths, first_rank, first_seq, offset = slots(plan_patterns(histogram), capacity)
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("shift"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("task", "shift")
    schema = with_fields(ranked.drop("rank"), "sequence_id long, offset long")
    keys = (lengths << 44) | first_rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (batch.column("length").to_numpy(zero_copy_only=False) << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in schema.names[:-2]), pa.array(first_seq[at] + rank - first_rank[at]), pa.array(offset[at])],
                names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_texts(df: DataFrame, tokenizer_file: str, rank_file: str, pattern: str, special: str, end_id: int, capacity: int,
               text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token pieces of every row's whole text and their places in sequences of at most ``capacity`` ids."""
    pieces = token_pieces(df, lambda: PairTable(tokenizer_file, rank_file, pattern, special), end_id, capacity, text, key)
    return pack(pieces, capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
