"""Removal of byte passages that occur elsewhere: exact, by suffix arrays over the places that can match.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus. Every such string (a window) is known
by its anchor, the leftmost smallest hash of its ``GRAM``-byte grams, which depends on the window alone. Windows with the same anchor in one
text form a segment. Equal windows have equal anchors at equal places, so:

1. each text's segments are listed (anchor, digest, place), about one per 150 bytes, equal ones of a text in one row; anchors that occur
   once in the corpus are dropped;
2. a segment that occurs again as a whole goes as a whole, in every text that has it;
3. different segments with one anchor are cut into ``STRIPS``: the windows that start in one strip of places before the anchor. All of
   them share a block of bytes, so strips whose block occurs once are dropped, equal strips go as a whole, and different ones with one
   block are compared by a suffix array (linear grouping) over their distinct contents: neighbours in its order with ``length`` common
   bytes are repeated windows. Blocks that more than ``MOST_CONTENTS`` different strips share would make one task's array too large: those
   strips are halved, which lengthens the block, round by round until no more share one (a strip of one window is its block);
   Before an array is built, strips are cut to what another one shares on both sides of the block, and the block becomes one letter;
4. the windows of a text are merged and cut out.

Several lengths go through the same passes, each with anchors of its own.

Texts are known by a 64-bit hash and their length, so copies of a text are listed once each but resolved once. Everything wide or
unbounded is shuffled by anchor, by window or by text.

Edge cases: null is the empty text; texts shorter than ``length`` keep everything; a window that repeats within one text counts, overlaps
too; repeated rows remove each other wholly if they are long enough; cutting may leave bytes that are no valid UTF-8 (``kept`` is binary);
an empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.chars import mix
from lockstep.llm.common import batches_of, hidden, materialize, prepared, text_or_empty, with_fields
from lockstep.llm.suffixes import suffix_array
from lockstep.session import scratch

LENGTH, GRAM = 400, 96
#: Different segments of one anchor that one suffix array holds (about 600 bytes each).
MOST_CONTENTS = 1500
#: Strips of the windows of an anchor: more of them share longer blocks and need smaller arrays, but are more rows.
STRIPS = 3
#: Bytes of one text handled by one numpy pass; longer texts are handled in overlapping parts.
PART_BYTES = 8_000_000
#: Bytes of short texts handled by one numpy pass: its arrays stay in a core's cache.
PASS_BYTES = 50_000
_PLACE_BITS = np.uint64(24)
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


@cache
def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [base] * (n - 1), np.uint64))


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from every place on: differences of running sums of the bytes' values times powers of ``_BASE``, scrambled."""
    n, size = len(raw), 1 << max(16, (len(raw) - 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * _powers(size, _BASE)[:n], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * _powers(size, pow(_BASE, -1, 2**64))[:n - gram + 1])


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, hashes: np.ndarray | None = None, starts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, start, end, place, anchor) of every segment: bytes ``start:end`` of its text, with the anchor at ``place``.

    ``hashes`` are those of the joined texts' grams, if known; windows of text i start before ``starts[i]``, if given.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    n, ends = int(sizes.sum()), np.cumsum(sizes)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if n < length:
        return empty
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram) if hashes is None else hashes
    m = length - gram + 1  # grams of a window
    packed = ((h >> _PLACE_BITS) << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    low, span = packed, 1
    while 2 * span <= m:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    windows = n - length + 1
    low = np.minimum(low[:windows], low[m - span: m - span + windows])
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[:windows]
    last = ends - length if starts is None else np.minimum(ends - length, ends - sizes + starts - 1)
    inside = np.arange(windows) <= last[text]
    start = np.flatnonzero(inside)
    if not len(start):
        return empty
    text, at = text[start], at[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    base = (ends - sizes)[text[new]]
    return text[new], start[new] - base, start[last] + length - base, at[new] - base, h[at[new]]


def parts(texts: list[bytes], length: int) -> tuple[list[int], list[int], list[bytes], list[int]]:
    """Texts, and long ones in parts that share ``length - 1`` bytes: (text, offset, bytes, starts that are the part's own)."""
    which, offset, out, own = [], [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), PART_BYTES):
            which.append(i)
            offset.append(a)
            out.append(t[a:a + PART_BYTES + length - 1] if len(t) > PART_BYTES else t)
            own.append(PART_BYTES if a + PART_BYTES < len(t) - length + 1 else len(t))
    return which, offset, out, own


def keyed(df: DataFrame, text: str) -> DataFrame:
    """``h, n, text``: the text's hash and byte length stand for it in joins."""
    t = text_or_empty(text)
    return df.select(F.xxhash64(t).alias("h"), F.octet_length(t).alias("n"), t.alias("text"))


@contextmanager
def _folder(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Writes frames to a shared folder and reads them back: columns of many slim rows are far smaller there than a checkpoint's rows."""
    path = scratch(spark, "passages")

    def stored(df: DataFrame) -> DataFrame:
        where = f"{path}/{uuid.uuid4().hex}"
        df.write.parquet(where)
        return spark.read.schema(df.schema).parquet(where)

    try:
        yield stored
    finally:
        with suppress(OSError, ValueError, NotImplementedError):  # nothing reads it any more; a store that pyarrow does not know keeps it
            store, place = pa_fs.FileSystem.from_uri(path)
            store.delete_dir(place)


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _segment_rows(rows: DataFrame, *lengths: int) -> DataFrame:
    """``h, n, length, start, end, place, anchor, digest, starts`` of the segments of every text, for each length: one row for equal ones,
    the first and all starts. Anchors of different lengths differ."""
    def listed(length: int, which: list[int], offset: list[int], texts: list[bytes], own: list[int], hashes: np.ndarray) -> tuple | None:
        t, start, end, place, anchor = segments(texts, length, GRAM, hashes, np.array(own))
        if not len(t):
            return None
        anchor = anchor ^ np.uint64(length)
        digest = np.array([xxhash.xxh3_64_intdigest(texts[i][x:y]) for i, x, y in zip(t.tolist(), start.tolist(), end.tolist(), strict=True)], np.uint64)
        order = np.lexsort((start, digest, anchor, t))
        t, start, end, place, anchor, digest = (x[order] for x in (t, start, end, place, anchor, digest))
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])])
        base = np.array(offset)[t]
        many = np.diff(np.append(np.flatnonzero(new), len(t)))
        t, at = t[new], base[new]
        return np.array(which)[t], np.full(len(t), length), *(x[new] + at for x in (start, end, place)), *(x[new].view(np.int64) for x in (anchor, digest)), many, start + base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, offset, some, own = parts(_bytes(batch.column(2)), max(lengths))
            found = []
            for c, d in batches_of(some, PASS_BYTES):
                raw = np.frombuffer(b"".join(some[c:d]), np.uint8)
                if len(raw) >= GRAM:
                    hashes = gram_hashes(raw)
                    found += [x for length in lengths if (x := listed(length, which[c:d], offset[c:d], some[c:d], own[c:d], hashes))]
            if found:
                row, *slim, many, starts = (np.concatenate(x) for x in zip(*found, strict=True))
                starts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(starts))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(slim[0], pa.int32()), *(pa.array(x) for x in slim[1:]), starts],
                                                 names=["h", "n", "length", "start", "end", "place", "anchor", "digest", "starts"])

    return rows.mapInArrow(run, "h long, n int, length int, start long, end long, place long, anchor long, digest long, starts array<long>")


def reach(sides: list[bytes]) -> list[int]:
    """How many first bytes of each are those of any other one, too."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    best = [0] * len(sides)
    for i, j in zip(order, order[1:], strict=False):  # the nearest ones in order share most
        a, b = sides[i], sides[j]
        m = min(len(a), len(b))
        same = m - ((int.from_bytes(a[:m]) ^ int.from_bytes(b[:m])).bit_length() + 7) // 8
        best[i], best[j] = max(best[i], same), same
    return best


def around_block(contents: list[bytes], length: int, blocks: list[int], common: int) -> list[list[tuple[int, int]]]:
    """``repeated_windows`` of contents whose windows all hold the same ``common`` bytes, which start at ``blocks`` in each: contents are
    first cut to what any other one shares on both sides of the block, as no window beyond that repeats."""
    before = reach([c[:a][::-1] for c, a in zip(contents, blocks, strict=True)])
    behind = reach([c[a + common:] for c, a in zip(contents, blocks, strict=True)])
    left = [i for i, (x, y) in enumerate(zip(before, behind, strict=True)) if x + common + y >= length]
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    cuts: dict[tuple[bytes, int], list[int]] = {}
    for i in left:
        cuts.setdefault((contents[i][blocks[i] - before[i]:blocks[i] + common + behind[i]], before[i]), []).append(i)
    alone = [[]] * len(cuts)
    for ((c, _), same), found in zip(cuts.items(), repeated_windows([c for c, _ in cuts], length, [a for _, a in cuts], common) if len(cuts) > 1 else alone, strict=True):
        own = [(0, len(c))] if len(same) > 1 else found
        for i in same:
            out[i] = [(x + blocks[i] - before[i], y + blocks[i] - before[i]) for x, y in own]
    return out


def repeated_windows(contents: list[bytes], length: int, blocks: list[int] | None = None, common: int = 0) -> list[list[tuple[int, int]]]:
    """For distinct contents: byte ranges covered by windows that start at another place too, by a suffix array of all of them.

    Where all windows of all contents hold the same ``common`` bytes, which start at ``blocks`` in each, those are one letter of its text.
    """
    one = np.array([257] if common else [], np.uint16)
    letters = [np.frombuffer(c, np.uint8).astype(np.uint16) + np.uint16(1) for c in contents]
    letters = [np.concatenate([x[:a], one, x[a + common:], [0]]) for x, a in zip(letters, blocks or [0] * len(contents), strict=True)]
    sizes = [len(x) for x in letters]
    owner, first = np.repeat(np.arange(len(contents)), sizes), np.cumsum([0, *sizes])
    joined = np.concatenate(letters).astype(np.uint16)
    raw, span = joined.tobytes(), length - common + len(one)
    place = np.array(suffix_array(joined.tolist()), np.int64)
    whole = place[place + span < first[owner[place] + 1]].tolist()  # suffixes with a whole window; equal windows are neighbours among them
    found: list[list[int]] = [[] for _ in contents]
    previous = None
    marked = -1
    for p in whole:
        if previous is not None and raw[2 * p:2 * (p + span)] == raw[2 * previous:2 * (previous + span)]:
            for q in (previous, p) if marked != previous else (p,):
                found[owner[q]].append(q - int(first[owner[q]]))
            marked = p
        previous = p
    return [merged([(o, o + length) for o in sorted(set(f))]) for f in found]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _fetched(rows: DataFrame, wanted: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``length, anchor, digest, place, content`` of the wanted segments (``h, n, length, start, size, place, anchor, digest``), cut from
    their texts; ``place`` is the anchor's in the content."""
    # a text's own segments; written, so that the join may split the copies of one text
    asked = stored(wanted.groupBy("h", "n").agg(F.collect_list(F.struct("length", "start", "size", "place", "anchor", "digest")).alias("asked")))
    texts = rows.join(asked, ["h", "n"]).select("h", "n", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies of a text need no second cut
        for batch in batches:
            out = []
            for h, n, raw, asked_here in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if (h, n) not in seen:
                    if len(seen) < 100_000:
                        seen.add((h, n))
                    out += [(x["length"], x["anchor"], x["digest"], x["place"], raw[x["start"]:x["start"] + x["size"]]) for x in asked_here]
            yield pa.RecordBatch.from_arrays([*(pa.array([o[k] for o in out], pa.int64()) for k in range(4)), pa.array([o[4] for o in out], pa.binary())],
                                             names=["length", "anchor", "digest", "place", "content"])

    return texts.mapInArrow(run, "length long, anchor long, digest long, place long, content binary")


def strip(content: bytes, place: int, lo: int, hi: int, length: int) -> tuple[int, bytes, bytes] | None:
    """(offset in the content, bytes covered by the windows that start ``lo .. hi - 1`` bytes before the anchor, bytes common to them)."""
    first, last = max(0, place - (hi - 1)), min(len(content) - length, place - lo)
    return (first, content[first:last + length], content[place - lo: place - (hi - 1) + length]) if first <= last else None


def borders(length: int, gram: int = GRAM, number: int = STRIPS) -> list[tuple[int, int]]:
    """The strips of an anchor's windows: distances before the anchor, the second one not included."""
    cuts = [k * (length - gram + 1) // number for k in range(number + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def strips(content: bytes, place: int, length: int, gram: int = GRAM, number: int = STRIPS) -> list[tuple[int, int, bytes]]:
    """(strip, offset in the content, bytes that the strip's windows cover) of every strip with a window in the content."""
    found = ((k, strip(content, place, lo, hi, length)) for k, (lo, hi) in enumerate(borders(length, gram, number)))
    return [(k, *cut[:2]) for k, cut in found if cut]


_STRIP = "key long, part long, length long, anchor long, digest long, offset long, place long, lo long, hi long, content binary"


def _strip_batch(found: list[tuple]) -> pa.RecordBatch:
    """Rows of ``_STRIP`` from (length, anchor, digest, offset, place, lo, hi, strip's bytes, block)."""
    keys = [xxhash.xxh3_64_intdigest(f[8], seed=(f[1] + 1_000_003 * f[5] + f[6]) & (2**64 - 1)) for f in found]
    parts_of = [xxhash.xxh3_64_intdigest(f[7]) for f in found]
    return pa.RecordBatch.from_arrays([*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, parts_of)),
                                       *(pa.array([f[i] for f in found], pa.int64()) for i in range(7)), pa.array([f[7] for f in found], pa.binary())],
                                      names=[c.split()[0] for c in _STRIP.split(", ")])


def _strip_rows(contents: DataFrame, *lengths: int) -> DataFrame:
    """The strips of every content; ``key`` stands for anchor, strip and shared block, ``part`` for the strip's bytes."""
    ranges = {n: borders(n) for n in lengths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _strip_batch([(n, a, d, cut[0], place - cut[0], lo, hi, *cut[1:])
                                for n, a, d, place, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)
                                for lo, hi in ranges[n] if (cut := strip(c, place, lo, hi, n))])

    return contents.select("length", "anchor", "digest", "place", "content").mapInArrow(run, _STRIP)


def _halved(rows: DataFrame) -> DataFrame:
    """Every strip as two of half its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, a, d, offset, place, lo, hi, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                middle = (lo + hi) // 2
                out += [(n, a, d, offset + cut[0], place - cut[0], x, y, *cut[1:]) for x, y in ((lo, middle), (middle, hi))
                        if x < y and (cut := strip(c, place, x, y, n))]
            yield _strip_batch(out)

    return rows.select("length", "anchor", "digest", "offset", "place", "lo", "hi", "content").mapInArrow(run, _STRIP)


def _by_suffix_array(strips: DataFrame) -> DataFrame:
    """``anchor, digest, lo, hi``: repeated ranges of the contents of each anchor, one bounded array per shared block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, of = None, {}, {}

        def out() -> list[tuple[int, int, int, int]]:
            ranges = {p: [(0, len(c))] for some in held.values() for p, (c, _) in some.items() if len(of[p]) > 1}
            for (length, block), some in held.items():  # one, but where keys clash
                if len(some) > 1:
                    for p, found in zip(some, around_block([c for c, _ in some.values()], length, [at for _, at in some.values()], len(block)), strict=True):
                        ranges.setdefault(p, found)
            return [(a, d, o + x, o + y) for p, found in ranges.items() for a, d, o in of[p] for x, y in found]

        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for k, p, n, a, d, o, place, lo, hi, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != key:
                    found += out()
                    key, held, of = k, {}, {}
                held.setdefault((n, c[place - lo:place - (hi - 1) + n]), {})[p] = c, place - lo
                of.setdefault(p, []).append((a, d, o))
            yield _ranges(found)
        yield _ranges(out())

    return strips.select(*(c.split()[0] for c in _STRIP.split(", "))).repartition("key").sortWithinPartitions("key").mapInArrow(run, "anchor long, digest long, lo long, hi long")


def _ranges(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], names=["anchor", "digest", "lo", "hi"])


def _by_rounds(strips: DataFrame, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same where a block may be shared by very many strips: those are halved until none is."""
    strips, found = stored(strips), []
    while True:
        kinds = strips.select("key", "part").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = stored(kinds.where(F.col("n") > MOST_CONTENTS).select("key"))
        if not large.limit(1).count():
            found.append(_by_suffix_array(strips))
            break
        found.append(_by_suffix_array(strips.join(large, "key", "left_anti")))
        strips = stored(_halved(strips.join(large, "key", "left_semi")))
    return reduce(DataFrame.unionByName, found)


def repeated_ranges(df: DataFrame, text: str = "text", *lengths: int) -> DataFrame:
    """``h, n, ranges``: per text with any, the sorted byte ranges (``length, a, b``) that go, for each length."""
    with _folder(df.sparkSession) as stored:
        return _repeated_ranges(keyed(df, text), lengths or (LENGTH,), stored)


def _repeated_ranges(rows: DataFrame, lengths: tuple[int, ...], stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    listed = _segment_rows(rows.where(F.col("n") >= min(lengths)), *lengths)
    size, place = (F.col("end") - F.col("start")).cast("int").alias("size"), (F.col("place") - F.col("start")).cast("int").alias("place")
    listed = stored(listed.select("h", "n", "length", size, place, "anchor", "digest", "starts"))
    # anchors seen once are dropped first, on two slim columns
    times = F.sum(F.size("starts")).alias("times")
    again = stored(listed.groupBy("anchor").agg(times).where("times > 1").select("anchor"))  # written, so that the join may split a frequent anchor's rows
    shared = stored(listed.join(again, "anchor", "left_semi"))
    one = F.min(F.struct("h", "n", "length", F.col("starts")[0].alias("start"), "size", "place")).alias("one")
    kinds = stored(shared.groupBy("anchor", "digest").agg(times, one))
    whole = kinds.where("times > 1").select("anchor", "digest", F.lit(0).cast("long").alias("lo"), F.col("one.size").cast("long").alias("hi"))
    several = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1"))
    wanted = kinds.join(several, "anchor").select("one.*", "anchor", "digest")
    many = several.where(F.col("contents") > MOST_CONTENTS).select("anchor")
    contents = stored(_fetched(rows, wanted, stored))
    some = _by_suffix_array(_strip_rows(contents.join(many, "anchor", "left_anti"), *lengths))
    if many.limit(1).count():
        some = some.unionByName(_by_rounds(_strip_rows(contents.join(many, "anchor", "left_semi"), *lengths), stored))
    # one row per segment's content, so that a text's segment meets one row; copies of a text are resolved once
    inside = whole.unionByName(some).groupBy("anchor", "digest").agg(F.collect_set(F.struct("lo", "hi")).alias("inside"))
    own = shared.select("h", "n", "length", "starts", "anchor", "digest").distinct().join(inside, ["anchor", "digest"])
    at = own.select("h", "n", F.flatten(F.transform("starts", lambda s: F.transform("inside", lambda x: F.struct("length", (s + x["lo"]).alias("a"), (s + x["hi"]).alias("b"))))).alias("at"))
    return materialize(at.groupBy("h", "n").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("ranges")))  # a text's own ranges


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join([raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True)])


def cut(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (array of start and end bytes), ``kept`` (binary) and
    ``kept_text`` (``kept`` without the bytes of characters that were cut through). With ``shorter``, a column ``shorter_text`` follows:
    the text without the strings of that many bytes that repeat, found in the same passes."""
    prepared(df.sparkSession)
    ranges = repeated_ranges(df, text, length, *([shorter] if shorter else []))
    h, n, r, t = (hidden(x) for x in ("h", "n", "r", "t"))
    whole = text_or_empty(text)
    rows = df.select(*(F.col(c) for c in keep), whole.alias(t), F.xxhash64(whole).alias(h), F.octet_length(whole).alias(n))
    joined = rows.join(ranges.select(F.col("h").alias(h), F.col("n").alias(n), F.col("ranges").alias(r)), [h, n], "left").select(*keep, t, r)
    fields = "n_bytes long, n_removed long, n_spans long, spans array<struct<a: bigint, b: bigint>>, kept binary, kept_text string"
    schema = with_fields(joined.select(*keep), fields + ", shorter_text string" * bool(shorter))
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = _bytes(batch.column(k)), batch.column(k + 1).to_pylist()

            def spans_of(some: int) -> list[list[tuple[int, int]]]:
                return [merged([(x["a"], x["b"]) for x in own or () if x["length"] == some]) for own in found]

            spans = spans_of(length)
            kept = [_without(raw, gone) for raw, gone in zip(texts, spans, strict=True)]
            less = [[_without(raw, gone) for raw, gone in zip(texts, spans_of(shorter), strict=True)]] if shorter else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(texts, kept, strict=True)], pa.int64()),
                 pa.array([len(s) for s in spans], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                 pa.array(kept, pa.binary()), *(pa.array([x.decode("utf-8", "ignore") for x in some], pa.string()) for some in (kept, *less))], names=schema.names)

    return joined.mapInArrow(run, schema)
