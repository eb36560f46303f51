"""Document fingerprints of closed syncmers, matched by hash and position.

A ``K``-gram of code points is an anchor if its smallest inner ``S``-gram stands at its first or last place: that depends on the K-gram
alone, so an edit changes only the anchors that overlap it. A fingerprint keeps the ``ANCHORS`` smallest anchor hashes of a text with their
positions (all, if fewer), headed by the text's length and hash: equal texts have equal fingerprints and others differ. Likeness is the
estimated Jaccard index of the anchors in the joint bottom sketch, where a common anchor counts only if it keeps its distance to a
neighbouring common anchor (a single common anchor counts alone). Texts too short for an anchor are alike only if they are equal.

The next document is the one with the next smaller id (after the last: the first); rows with the same id follow each other by text, a null
id comes last. Texts are cut into id ranges and shuffled once; only the first document of a range is sent to two ranges.

Edge cases: null text is the empty text; a single row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.chars import code_points, mix
from lockstep.llm.common import batches_of, prepared, strings, text_or_empty

K, S = 16, 5
ANCHORS = 96
#: How far the distance of two common anchors may drift.
DRIFT = 8
#: Rows of an id range, about; of larger tables the ranges grow, so that their number stays near this.
RANGE_ROWS, MAX_RANGES = 2000, 2000
#: Stands for a null id, which comes last.
LOWEST = -(2**63)
#: Characters hashed by one pass: few enough that its arrays stay in a core's cache.
PASS_CHARS = 150_000
#: Factors of the hashes of 2, 4, 8 and 16 code points, and of S.
_DOUBLE, _NEXT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def syncmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the closed syncmers of every text, in order."""
    points, starts = code_points(texts)
    n = len(points) - K + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    one = points.astype(np.uint64) + np.uint64(1)  # hashes of 1, 2 and 4 code points; from them those of S = 1 + 4
    two = one[:-1] * _DOUBLE + mix(one[1:], 77)
    four = two[:-2] * _DOUBLE + mix(two[2:], 77)
    small = mix(mix(one[:-4], 1) * _NEXT + mix(four[1:], 4), S)
    inner = K - S + 1
    low, span = small, 1  # least inner gram of each place
    while 2 * span <= inner:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[inner - span: inner - span + n])
    at = np.flatnonzero((small[:n] == low) | (small[inner - 1: inner - 1 + n] == low))
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + K < starts[text + 1]  # the joint after a text belongs to none
    at, text = at[inside], text[inside]
    # K = 16 code points, at the anchors alone
    eight = four[at] * _DOUBLE + mix(four[at + 4], 77), four[at + 8] * _DOUBLE + mix(four[at + 12], 77)
    return text, at - starts[text], mix(mix(eight[0] * _DOUBLE + mix(eight[1], 77), K), K)


class Sketches(NamedTuple):
    """Anchors of many texts, one after the other: those of text ``i`` are ``ends[i]:ends[i + 1]``."""

    text: np.ndarray
    hash: np.ndarray
    position: np.ndarray
    ends: np.ndarray

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.hash[self.ends[i]:self.ends[i + 1]], self.position[self.ends[i]:self.ends[i + 1]]

    def part(self, i: int, j: int) -> Sketches:
        """Those of texts ``i`` to ``j - 1``, numbered from 0."""
        a, b = self.ends[i], self.ends[j]
        return Sketches(self.text[a:b] - i, self.hash[a:b], self.position[a:b], self.ends[i:j + 1] - a)


def _by_text(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Order by text (below ``n``) and hash."""
    order = np.argsort(h)
    text = text[order]
    return order[np.argsort(text.astype(np.uint16) if n <= 2**16 else text, kind="stable")]


def _distinct(text: np.ndarray, h: np.ndarray, position: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first position) by text and hash."""
    order = _by_text(text, h, n)
    text, h, position = text[order], h[order], position[order]
    if not len(h):
        return text, h, position
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
    return text[first], h[first], np.minimum.reduceat(position, first)


def _smallest(text: np.ndarray, h: np.ndarray, position: np.ndarray, n: int) -> Sketches:
    """The ``ANCHORS`` smallest hashes of each text, of distinct ones in order."""
    ends = np.searchsorted(text, np.arange(n + 1))
    few = np.arange(len(text)) - ends[text] < ANCHORS
    ends = np.concatenate([[0], np.cumsum(np.minimum(np.diff(ends), ANCHORS))])
    return Sketches(text[few], h[few], position[few], ends)


def sketches(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes (ascending) and positions (of the first occurrence) of each text's smallest distinct anchors."""
    text, position, h = syncmers(texts)
    found = _smallest(*_distinct(text, h, position, len(texts)), len(texts))
    return [found.one(i) for i in range(len(texts))]


def chained(texts: list[str]) -> tuple[Sketches, Sketches]:
    """Sketches of all texts, and of each but the last after the edit by the next one.

    An anchor of an edited text lies in what is left of the text, in what comes from the next or across their joint: only the joints are
    hashed anew."""
    n, sizes = len(texts) - 1, np.array([len(t) for t in texts], np.int64)
    half = sizes[:-1] // 2
    left, filled = sizes[:-1] - half, np.minimum(half, sizes[1:])
    before = np.maximum(left - (K - 1), 0)
    joints = [x[a:b] + y[:c] for x, y, a, b, c in zip(texts, texts[1:], before.tolist(), left.tolist(), np.minimum(filled, K - 1).tolist(), strict=False)]
    text, position, h = syncmers([*texts, *joints])
    own = int(np.searchsorted(text, n + 1))
    joint = text[own:] - (n + 1)
    across = joint, h[own:], position[own:] + before[joint]
    text, h, position = _distinct(text[:own], h[:own], position[:own], n + 1)
    end = position + K
    kept = end <= np.append(left, 0)[text]
    taken = end <= np.append(0, filled)[text]
    stays = _smallest(text[kept], h[kept], position[kept], n)
    of = text[taken] - 1
    comes = _smallest(of, h[taken], position[taken] + left[of], n)
    changed = _distinct(*(np.concatenate(x) for x in zip(stays[:3], across, comes[:3], strict=True)), n)
    return _smallest(text, h, position, n + 1), _smallest(*changed, n)


def likenesses(a: Sketches, b: Sketches, equal: np.ndarray) -> np.ndarray:
    """Estimated share of common anchors among all, common ones counted by position as well, of every text of ``a`` with that of ``b``."""
    n = len(equal)
    pair, h, position = (np.concatenate(x) for x in zip(a[:3], b[:3], strict=True))
    order = _by_text(pair, h, n)
    pair, h, position, second = pair[order], h[order], position[order], order >= len(a.hash)
    new = np.ones(len(h), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (h[1:] != h[:-1])
    total = np.bincount(pair[new], minlength=n)  # distinct anchors of both
    rank = np.cumsum(new) - 1 - (np.cumsum(total) - total)[pair]
    at = np.flatnonzero(~new & (rank < ANCHORS))  # here and just before: one common anchor
    pair, turned = pair[at], second[at - 1]
    pa_, pb = np.where(turned, position[at], position[at - 1]), np.where(turned, position[at - 1], position[at])
    order = np.lexsort((pa_, pair))
    pair, shift = pair[order], (pa_ - pb)[order]
    steady = (np.abs(np.diff(shift)) <= DRIFT) & (pair[1:] == pair[:-1])
    common = np.bincount(pair, minlength=n)
    kept = np.bincount(pair[np.append(steady, False) | np.insert(steady, 0, False)], minlength=n) if len(pair) else common
    return np.where(equal, 1.0, np.where(common == 1, 1, kept) / np.clip(total, 1, ANCHORS))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], equal: bool) -> float:
    """The same of two texts."""
    x, y = (Sketches(np.zeros(len(s[0]), np.int64), *s, np.array([0, len(s[0])])) for s in (a, b))
    return float(likenesses(x, y, np.array([equal]))[0])


def written(text: str, sketch: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: length, 64-bit text hash, then ``hash@position`` of every anchor."""
    head = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    pairs = np.stack([sketch[0], sketch[1].astype(np.uint64)], 1).ravel().tolist()
    return f"{len(text)}:{head}:" + ("%x@%x," * len(sketch[0]) % tuple(pairs))[:-1]


def edited(text: str, following: str) -> str:
    """The text whose second half is replaced by the beginning of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (``key, order, text``) with ``range``, which rises from the top. Quantiles of the ids that are there cut the ranges; an id
    (or null) with more rows than a range is alone in its stretch, and its rows are cut by text hash."""
    slim = rows.select("order", F.col("key").isNotNull().alias("named"))
    n, n_named = slim.agg(F.count(F.lit(1)), F.count_if("named")).first()
    size = max(RANGE_ROWS, -(-n // MAX_RANGES))
    parts = -(-n_named // size)
    cuts = slim.where("named").stat.approxQuantile("order", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    cuts = {min(max(int(c), LOWEST), -LOWEST - 1) for c in cuts}
    heavy = slim.groupBy("order", "named").count().where(F.col("count") > size).collect() if n > size else []
    cuts = sorted(cuts | {c for r in heavy if r.named for c in (r.order, r.order - 1) if c >= LOWEST})
    number = F.when(F.col("key").isNull(), len(cuts) + 1).otherwise(len(cuts) - _below(F.col("order"), cuts))
    pieces = [1] * (len(cuts) + 2)
    for r in heavy:
        pieces[len(cuts) - bisect_left(cuts, r.order) if r.named else len(cuts) + 1] = -(-r["count"] // size)
    if not heavy:
        return rows.withColumn("range", number.cast("int"))
    first = F.get(F.array(*[F.lit(x) for x in accumulate([0, *pieces[:-1]])]), number)
    many = F.get(F.array(*[F.lit(x) for x in pieces]), number)
    # hashes are even: equal steps from the highest down
    piece = F.when(many > 1, F.least(many - 1, F.floor((F.lit(0.5) - F.xxhash64("text") / F.lit(2.0**64)) * many))).otherwise(0)
    return rows.withColumn("range", (first + piece).cast("int"))


def _below(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are less than ``value``: whole blocks first, then the cuts of one block."""
    step = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    if not blocks:
        return F.lit(0)
    known = F.array(*[F.array(*[F.lit(c) for c in block]) for block in [*blocks, [-LOWEST - 1]]])  # nothing is above the last block
    whole = F.size(F.filter(F.array(*[F.lit(block[-1]) for block in blocks]), lambda c: c < value))
    return F.least(whole * step, F.lit(len(cuts))) + F.size(F.filter(F.get(known, whole), lambda c: c < value))


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`` of every row and its edited text."""
    prepared(df.sparkSession)
    order = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    rows = _ranges(df.select(F.col(key).alias("key"), order.alias("order"), text_or_empty(text).alias("text")))
    # one slim row per range: its highest id and text hash, to find the row that follows the range above (after the lowest: the highest)
    tag = F.struct(F.col("order"), F.col("key").isNotNull().alias("named"), F.xxhash64("text").alias("h"))
    heads = sorted(rows.groupBy("range").agg(F.max(tag).alias("head")).collect())  # a few thousand rows at most
    parts = heads[-1].range + 1 if heads else 1
    above: list = [(0, False, 0, 0)] * parts  # a range without rows is never looked up
    for before, r in zip([*heads[-1:], *heads], heads, strict=False):
        above[r.range] = (*r.head, before.range)
    order, named, h, guest_of = (F.get(F.array(*[F.lit(x[i]) for x in above]), F.col("range")) for i in range(4))
    top = (F.col("order") == order) & (F.col("key").isNotNull() == named) & (F.xxhash64("text") == h)
    sent = F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.when(top, F.struct(guest_of.alias("range"), F.lit(True).alias("guest")))))
    dealt = rows.select("key", "order", "text", F.explode(sent).alias("to")).select("key", "order", "text", "to.range", "to.guest")
    # every range is a task of its own: hashed, several would meet in one
    dealt = dealt.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "guest", F.desc("order"), F.desc(F.col("key").isNotNull()), F.desc(F.xxhash64("text")))
    key_type = df.select(key).schema[0].dataType.simpleString()
    ddl = f"`key` {key_type}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def judged(keys: list, texts: list[str], following: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows of consecutive documents; ``following[i]`` is the text after ``texts[i]``."""
        for a, b in batches_of(texts, PASS_CHARS):
            own, after = texts[a:b], following[a:b]
            changed = [edited(x, y) for x, y in zip(own, after, strict=True)]
            mine, theirs = chained([*own, after[-1]])
            near = (likenesses(mine.part(0, b - a), other, np.array([s == t for s, t in zip(own, like, strict=True)]))
                    for other, like in ((theirs, changed), (mine.part(1, b - a + 1), after)))
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[a:b], key_array_type), pa.array([len(x) for x in own], pa.int64()), pa.array(changed, pa.string()),
                pa.array([written(x, mine.one(i)) for i, x in enumerate(own)], pa.string()), pa.array([written(x, theirs.one(i)) for i, x in enumerate(changed)], pa.string()),
                *(pa.array(x, pa.float64()) for x in near)],
                names=["key", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    key_array_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(key_type, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last document, until the one after it is seen
        for batch in batches:
            keys, texts, ranges, guests = batch.column(0).to_pylist(), strings(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            own, mine, after = [], [], []
            for row in zip(keys, texts, ranges, guests, strict=True):
                if held is not None:
                    own.append(held[0])
                    mine.append(held[1])
                    after.append(row[1])
                held = None if row[3] else row
            # a range's last document is always followed by a guest, so runs of one range stay whole
            yield from _split(own, mine, after, judged)
        if held is not None:
            raise RuntimeError("a range without its guest")

    return dealt.mapInArrow(run, ddl).withColumnRenamed("key", key)


def _split(keys: list, texts: list[str], following: list[str], judged) -> Iterator[pa.RecordBatch]:
    """Cut where the following document isn't the next row (the end of a range)."""
    start = 0
    for i in range(len(texts)):
        if i + 1 == len(texts) or following[i] is not texts[i + 1]:
            yield from judged(keys[start:i + 1], texts[start:i + 1], following[start:i + 1])
            start = i + 1
