"""Near duplicates by BagMinHash: weighted Jaccard of word 5-shingle multisets, banded and verified.

A shingle with count w owns the cells [0, w) of the discretised weight axis. Every dyadic block of cells ([0,1), [1,2), [2,4), ...) has one
Poisson process, seeded by shingle and block, with one point per cell and unit of time on average; a point falls on a cell of its block and
on a register, and counts only if its cell is owned. So heavy shingles cost one process per doubling, and two documents share exactly the
points of the cells that both own: a register's first point is common with the probability of their weighted Jaccard index. Points are
drawn in order for all documents of a batch at once, until no later point can be the first of any register.

Documents with the same word sequence are one content. Contents that share a band are candidates; the exact weighted Jaccard index of
their multisets decides. Pairs are not expanded within a bucket: its first content - the one whose buckets hold most contents, so the
original rather than a variant - is compared with the others; contents that are in one component by then need no more comparison. Buckets
that still hold several components are compared whole, in blocks of bounded size inside tasks: pairs whose registers agree often enough are
verified there, each in the first bucket that it shares, and only those that join two components leave the task. Every pair of a bucket is
compared or in one component; nothing is capped.

``BANDS`` of ``ROWS`` registers miss a pair of similarity 0.8 with probability 5e-6 and bring one of 0.4 together with 0.15. Words are runs of letters and digits in lower case.

Edge cases: null is the empty text; texts without a word are alike only if they are equal; a text of fewer than five words is one shingle;
repeated rows, of the same id or not, are in one class; a null id is kept; an empty table gives no rows. Other columns do not pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.chars import WORD, Words, mix
from lockstep.llm.common import batches_of, hidden, materialize, prepared, strings, text_or_empty
from lockstep.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 40, 6
#: The bands use the first BANDS * ROWS registers; all of them estimate the similarity of two contents of one bucket.
REGISTERS = 480
#: Registers that must agree before multisets are compared: 4.5 standard deviations below the mean at SIMILAR (misses 4e-6).
LEAST_AGREEING = int(REGISTERS * SIMILAR - 4.5 * (REGISTERS * SIMILAR * (1 - SIMILAR)) ** 0.5)
#: Contents of one block of a bucket.
BLOCK = 1024
#: Points drawn at once for each process still running, at most.
MOST_POINTS = 32


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, shingle, count) of every text's multiset, and a 16-byte digest of every text's word sequence (or text, without words)."""
    words = Words(texts)
    words.only(words.kind == WORD)
    ends = np.searchsorted(words.text, np.arange(len(texts) + 1))
    contents = [hashlib.blake2b(words.hash[a:b].tobytes() if b > a else b"\0" + t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]
    text, h = words.shingles(SHINGLE)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], h[at], np.diff(np.append(at, len(h))), contents


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """First arrival times of every register, per text; infinite for texts without a shingle."""
    parts, level = [], 0
    while True:
        low = 0 if level == 0 else 1 << (level - 1)
        owns = np.flatnonzero(weight > low)
        if not len(owns):
            break
        parts.append((text[owns], mix(shingle[owns], 5000 + level), np.full(len(owns), max(1, low)), np.full(len(owns), low), weight[owns]))
        level += 1
    first = np.full(texts * registers, np.inf)
    if not parts:
        return first.reshape(texts, registers)
    owner, seed, rate, low, most = (np.concatenate(x) for x in zip(*parts, strict=True))
    now, drawn, points = np.zeros(len(owner)), np.zeros(len(owner), np.uint64), 1
    while len(owner):
        number = drawn[:, None] + np.arange(points, dtype=np.uint64)[None, :]
        a = mix(seed[:, None] + number * np.uint64(0x9E3779B97F4A7C15), 1)
        b = mix(a, 2)
        time = now[:, None] + np.cumsum(-np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53), axis=1) / rate[:, None]
        cell = low[:, None] + ((b & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32 * rate[:, None]).astype(np.int64)
        register = ((b >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        owned = cell < most[:, None]
        np.minimum.at(first, (owner[:, None] * registers + register)[owned], time[owned])
        now, drawn = time[:, -1], drawn + np.uint64(points)
        running = now < first.reshape(texts, registers).max(1)[owner]
        owner, seed, rate, low, most, now, drawn = (x[running] for x in (owner, seed, rate, low, most, now, drawn))
        points = min(MOST_POINTS, 2 * points)
    return first.reshape(texts, registers)


def band_keys(first: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of every signature."""
    bits = np.ascontiguousarray(first[:, :BANDS * ROWS]).view(np.uint64).reshape(len(first), BANDS, ROWS)
    total = np.zeros((len(first), BANDS), np.uint64)
    for k in range(ROWS):
        total = mix(total + mix(bits[:, :, k], 300 + k))
    return mix(total + np.arange(BANDS, dtype=np.uint64)[None, :], 9)


def register_marks(first: np.ndarray) -> list[bytes]:
    """One byte per register, for quick comparison."""
    return [r.tobytes() for r in (mix(first.view(np.uint64).ravel(), 21) >> np.uint64(56)).astype(np.uint8).reshape(first.shape)]


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tkey, text``; ``tkey`` stands for the text in joins."""
    t = text_or_empty(text)
    return df.select(F.col(key).alias("key"), F.struct(F.xxhash64(t).alias("h"), F.xxhash64(t, F.lit(1)).alias("g")).alias("tkey"), t.alias("text"))


def contents(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tkey, content, bands, marks`` of every row; ``bands`` is null without a shingle."""
    keyed = _keyed(df, key, text)
    kind = keyed.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(2))
            for a, b in batches_of(texts):
                owner, shingle, weight, digests = bags(texts[a:b])
                first = signatures(owner, shingle, weight, b - a)
                there = np.isfinite(first[:, 0])
                keys = band_keys(first).view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(digests, pa.binary()),
                     pa.array([k if t else None for k, t in zip(keys, there, strict=True)], pa.list_(pa.int64())),
                     pa.array(register_marks(first), pa.binary())], names=["key", "tkey", "content", "bands", "marks"])

    return keyed.mapInArrow(run, f"key {kind}, tkey struct<h: bigint, g: bigint>, content binary, bands array<bigint>, marks binary")


def _multisets(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``content, size, bag`` of the contents of the texts in ``wanted`` (``tkey``): sorted 32-bit shingle hashes with repeats."""
    rows = _keyed(df, key, text).join(wanted, "tkey", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = strings(batch.column(0))
            for a, b in batches_of(texts):
                owner, shingle, weight, digests = bags(texts[a:b])
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                out = []
                for i, d in enumerate(digests):
                    if d not in seen:
                        if len(seen) < 200_000:  # only saves work; the caller drops repeats
                            seen.add(d)
                        s, w = shingle[cuts[i]:cuts[i + 1]], weight[cuts[i]:cuts[i + 1]]
                        out.append((d, int(w.sum()), np.sort(np.repeat(s >> np.uint64(32), w)).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([o[2] for o in out], pa.binary())], names=["content", "size", "bag"])

    return rows.mapInArrow(run, "content binary, size long, bag binary").dropDuplicates(["content"])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted multisets."""
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(na[ia], nb[ib]).sum())
    return common / max(1, len(a) + len(b) - common)


def _verified(pairs: DataFrame, multisets: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose multisets are similar."""
    left = multisets.select(F.col("content").alias("a"), F.col("bag").alias("bag_a"))
    right = multisets.select(F.col("content").alias("b"), F.col("bag").alias("bag_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [weighted_jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= SIMILAR
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a binary, b binary")


class Block:
    """Contents of one bucket that meet in one task, as columns."""

    def __init__(self, rows: list[dict], band: int):
        self.content = [r["content"] for r in rows]
        self.marks = np.frombuffer(b"".join([r["marks"] for r in rows]), np.uint8).reshape(len(rows), REGISTERS)
        self.size = np.array([r["size"] for r in rows], float)
        self.bands = np.array([r["bands"] for r in rows], np.int64)
        self.own = np.array([r["own"] for r in rows])
        self.band = band
        self.bags = [np.frombuffer(r["bag"], "<u4") for r in rows]
        self.counted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        _, self.top = np.unique(np.array([r["root"] for r in rows], object), return_inverse=True)

    def _counts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.counted:
            self.counted[i] = np.unique(self.bags[i], return_counts=True)
        return self.counted[i]

    def similar(self, i: int, j: int) -> bool:
        (ua, na), (ub, nb) = self._counts(i), self._counts(j)
        _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
        common = int(np.minimum(na[ia], nb[ib]).sum())
        return common >= SIMILAR * max(1, len(self.bags[i]) + len(self.bags[j]) - common)

    def links(self, bi: int, bj: int) -> list[tuple[bytes, bytes]]:
        """Similar pairs that join two components of the block, fewer than it has contents. A pair is looked at in the first of the
        buckets that both are in, and not at all once both are in one component."""
        out, n = [], len(self.content)
        for i in range(n):
            later = np.arange(i + 1, n) if bi == bj else np.flatnonzero(self.own == bj) if self.own[i] == bi else ()
            if len(later):
                later = later[(self.top[later] != self.top[i]) & (np.minimum(self.size[later], self.size[i]) >= SIMILAR * np.maximum(self.size[later], self.size[i]))]
                later = later[(self.marks[later] == self.marks[i]).sum(1) >= LEAST_AGREEING]
            if len(later):
                shared = (self.bands[later] == self.bands[i]).argmax(1)
                later = later[self.bands[i][shared] == self.band]
            for j in map(int, later):
                if self.top[i] != self.top[j] and self.similar(i, j):
                    out.append(tuple(sorted((self.content[i], self.content[j]))))
                    self.top[self.top == self.top[j]] = self.top[i]
        return out


def _block_links(active: DataFrame) -> DataFrame:
    """Links (``a, b``) between components, from ``band, content, root, size, marks, bands, bag, place, n``. A bucket is cut into blocks of
    ``BLOCK`` contents and every two blocks meet in one task, so a task holds two blocks and gives out fewer links than it holds contents."""
    block = F.floor(F.col("place") / BLOCK)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))
    dealt = (active.withColumn("own", block).withColumn("other", others)
             .select("band", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "content", "root", "size", "marks", "bands", "bag", "own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            pairs: list[tuple[bytes, bytes]] = []
            for row in batch.to_pylist():
                here = (row["band"], row["bi"], row["bj"])
                if here != at:
                    if len(held) > 1:
                        pairs += Block(held, at[0]).links(at[1], at[2])
                    at, held = here, []
                held.append(row)
            yield _pairs(pairs)
        yield _pairs(Block(held, at[0]).links(at[1], at[2]) if len(held) > 1 else [])

    return dealt.repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj").mapInArrow(run, "a binary, b binary")


def _pairs(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``content, root`` after the links: components of the components found so far."""
    if not links.limit(1).count():
        return labels
    by_root = materialize(links.join(labels.select(F.col("content").alias("a"), F.col("root").alias("ra")), "a")
                          .join(labels.select(F.col("content").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    merged = components(by_root).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialize(labels.join(merged, "root", "left").select("content", F.coalesce("top", "root").alias("root")))


def _content_roots(df: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame | None:
    """``content, root`` of the contents that share a bucket with another."""
    distinct = materialize(rows.where("bands IS NOT NULL").groupBy("content").agg(F.first("bands").alias("bands"), F.first("marks").alias("marks"), F.min("tkey").alias("tkey")))
    member = distinct.select("content", F.explode("bands").alias("band"))
    crowded = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(member.join(crowded, "band"))
    if not shared.limit(1).count():
        return None
    # contents in a fixed order inside every bucket, the best connected first: an original is likelier to be like all its variants
    facts = materialize(shared.groupBy("content").agg(F.sum("n").alias("weight")).join(distinct.drop("bands"), "content"))
    multisets = materialize(_multisets(df, key, text, facts.select("tkey")))
    facts = facts.join(multisets.select("content", "size"), "content")
    placed = materialize(shared.join(facts.select("content", "weight"), "content")
                         .withColumn("place", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("weight"), "content")) - 1).drop("weight"))
    first = placed.where("place = 0").select("band", F.col("content").alias("a"))
    stars = placed.where("place > 0").select("band", F.col("content").alias("b")).join(first, "band").select("a", "b").distinct()
    labels = facts.select("content", F.col("content").alias("root"))
    labels = _joined(labels, materialize(_verified(stars, multisets)))
    rooted = placed.join(labels, "content")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where(F.col("r0") != F.col("r1")).select("band")
    wide = facts.select("content", "marks").join(distinct.select("content", "bands"), "content").join(multisets, "content")
    return _joined(labels, materialize(_block_links(rooted.join(mixed, "band").join(wide, "content"))))


def _rooted(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tkey, root`` of every row; rows of one root are one class."""
    prepared(df.sparkSession)
    rows = materialize(contents(df, key, text))
    roots = _content_roots(df, rows, key, text)
    slim = rows.select("key", "tkey", F.col("content").alias("root"))
    if roots is not None:
        slim = slim.join(roots.select(F.col("content").alias("own"), F.col("root").alias("top")), F.col("own") == F.col("root"), "left").select(
            "key", "tkey", F.coalesce("top", "root").alias("root"))
    return materialize(slim)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, class_size`` of every row; ``class_id`` is the class's smallest id."""
    slim = _rooted(df, key, text)
    ids = slim.groupBy("root").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return slim.join(ids, "root").select(F.col("key").alias(key), "class_id", "class_size")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every class with all its columns: the one with the smallest id (then the smallest text hash)."""
    one = _rooted(df, key, text).groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "tkey")).alias("one"))
    k, t = hidden("key"), hidden("tkey")
    one = one.select(F.col("one.key").alias(k), F.col("one.tkey").alias(t))
    whole = text_or_empty(text)
    mine = hidden("own")
    rows = df.withColumn(mine, F.struct(F.xxhash64(whole).alias("h"), F.xxhash64(whole, F.lit(1)).alias("g")))
    kept = rows.join(one, (F.col(mine) == F.col(t)) & F.col(key).eqNullSafe(F.col(k)), "left_semi")
    # rows that repeat id and text: one of them
    place = hidden("place")
    first = F.row_number().over(Window.partitionBy(mine, key).orderBy(F.lit(0)))
    return kept.withColumn(place, first).where(F.col(place) == 1).select(*df.columns)
