"""Frame synchronisation over sync hits: which hits hold the lock, which bits were locked, which frames went missing.

The rule is sequential, but it only ever looks at hits (about one per frame), and what it carries forward is one bit offset and
one small count. Whatever a chunk is entered with, its first honoured hit lies within about a frame of its first hit, so a chunk is
summarised by where each such landing leads: one slim row. One pass over those rows in order gives every chunk's entry state, and
a second fold over the hits gives the result. Two folds and one scan of slim rows, whatever the data and the number of chunks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lockstep.operators.scans import per_stream
from lockstep.session import materialize

DROP, ANCHOR = 0, 1
NO_LOCK = -1
#: Missed frames listed by one row before they are listed one by one: a lost stream may miss more than an array can hold.
_MISSED_STRIDE = 100_000

_FOLD_SCHEMA = ("stream_id string, chunk long, kind int, bit long, anchor long, prev long, count int, locked long, "
                "missed long, frame boolean, boundary boolean")


def fold_hits(hits: np.ndarray, drops: np.ndarray, frame_bits: int, min_syncs: int, anchor: int, count: int) -> tuple:
    """Walk hits in bit order. Returns (rows, anchor, count); rows are (kind, bit, anchor, prev, count, locked, missed, frame,
    boundary). ``count`` is capped at ``min_syncs``: beyond it nothing changes."""
    rows = []
    bits, gaps = hits.tolist(), drops.tolist()
    place, gap_at, n, n_gaps = 0, 0, len(bits), len(gaps)

    def drop_until(limit: int | None) -> None:
        nonlocal gap_at, count
        while gap_at < n_gaps and (limit is None or gaps[gap_at] <= limit):
            g = gaps[gap_at]
            held = min(frame_bits, g - 1 - anchor) if count >= min_syncs else 0
            count = NO_LOCK
            rows.append((DROP, g, anchor, anchor, count, max(0, held), 0, False, False))
            gap_at += 1

    while place < n:
        p = bits[place]
        drop_until(p)
        d = p - anchor
        lost, offset = divmod(d - 1, frame_bits)
        held = count if lost == 0 else NO_LOCK
        boundary = offset == frame_bits - 1
        if held >= min_syncs and not boundary:
            resume = anchor + frame_bits
            if gap_at < n_gaps:
                resume = min(resume, gaps[gap_at])
            place = bisect_left(bits, resume, place + 1)
            continue
        after = held + 1 if boundary else 1
        locked = min(frame_bits, d) if count >= min_syncs else 0
        rows.append((ANCHOR, p, p, anchor, min(after, min_syncs), locked, lost,
                     boundary and held != NO_LOCK and after >= min_syncs, boundary))
        anchor, count = p, min(after, min_syncs)
        place += 1
    drop_until(None)
    return rows, anchor, count


class ChunkExits:
    """Where a chunk leads from every landing: a landing is the first honoured hit and the count after it."""

    def __init__(self, hits: list[int], drops: list[int], frame_bits: int, min_syncs: int):
        self.hits, self.drops, self.frame_bits, self.min_syncs = hits, drops, frame_bits, min_syncs
        self.exits: dict[tuple[int, int], tuple[int, int]] = {}

    def step(self, anchor: int, count: int, place: int) -> tuple[int, int] | None:
        """(place, count) of the next honoured hit at or after ``place``, or nothing if no hit is left."""
        gap_at = bisect_right(self.drops, anchor)
        gap = self.drops[gap_at] if gap_at < len(self.drops) else None
        if count >= self.min_syncs:
            resume = anchor + self.frame_bits if gap is None else min(anchor + self.frame_bits, gap)
            place = bisect_left(self.hits, resume, place)
        if place >= len(self.hits):
            return None
        lost, offset = divmod(self.hits[place] - anchor - 1, self.frame_bits)
        held = NO_LOCK if lost or (gap is not None and gap <= self.hits[place]) else count
        return place, min(held + 1 if offset == self.frame_bits - 1 else 1, self.min_syncs)

    def leave(self, anchor: int, count: int) -> tuple[int, int]:
        """State at the end of the chunk when ``anchor`` was the last honoured hit."""
        return anchor, NO_LOCK if self.drops and self.drops[-1] > anchor else count

    def exit(self, place: int, count: int) -> tuple[int, int]:
        """State at the end of the chunk after a landing. Ways that meet are walked once."""
        way, at = [], (place, count)
        while at is not None and at not in self.exits:
            way.append(at)
            at = self.step(self.hits[at[0]], at[1], at[0] + 1)
        end = self.exits[at] if at else self.leave(self.hits[way[-1][0]], way[-1][1])
        self.exits.update((w, end) for w in way)
        return end


_SUMMARY_SCHEMA = ("stream_id string, chunk long, bits_in_frame long, min_syncs int, early array<bigint>, first_drop long, "
                   "exit_anchor array<bigint>, exit_count array<int>")


def _summarise_chunk(table: pa.Table) -> pa.Table:
    """One slim row: the hits a landing may be on (in bit order, up to a frame past the first, and one more) and, for each of them
    and each count from 0 to ``min_syncs``, the state at the chunk's end."""
    first = {c: table.column(c)[0].as_py() for c in ("stream_id", "chunk", "bits_in_frame", "min_syncs")}
    kind, bit = table.column("kind").to_numpy(), table.column("bit").to_numpy()
    hits, drops = np.sort(bit[kind == ANCHOR]).tolist(), np.sort(bit[kind == DROP]).tolist()
    chunk = ChunkExits(hits, drops, first["bits_in_frame"], first["min_syncs"])
    latest = max([hits[0], *drops[:1]]) + first["bits_in_frame"] if hits else 0
    early = hits[:bisect_right(hits, latest) + 1]
    ends = [chunk.exit(i, c) for i in range(len(early)) for c in range(first["min_syncs"] + 1)]
    return pa.table([pa.array([v]) for v in first.values()] + [
        pa.array([early], pa.list_(pa.int64())), pa.array([drops[0] if drops else None], pa.int64()),
        pa.array([[e[0] for e in ends]], pa.list_(pa.int64())), pa.array([[e[1] for e in ends]], pa.list_(pa.int32()))],
        names=["stream_id", "chunk", "bits_in_frame", "min_syncs", "early", "first_drop", "exit_anchor", "exit_count"]).cast(pa.schema([
            ("stream_id", pa.string()), ("chunk", pa.int64()), ("bits_in_frame", pa.int64()), ("min_syncs", pa.int32()), ("early", pa.list_(pa.int64())),
            ("first_drop", pa.int64()), ("exit_anchor", pa.list_(pa.int64())), ("exit_count", pa.list_(pa.int32()))]))


def _entries(summaries: DataFrame) -> DataFrame:
    """Entry state of every chunk: one pass over the slim rows of a stream, which are streamed and never held together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, anchor, count = None, -1, NO_LOCK
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["stream_id"] != stream:
                    stream, anchor, count = row["stream_id"], -1, NO_LOCK
                out.append((stream, row["chunk"], anchor, count))
                drops = [row["first_drop"]] if row["first_drop"] is not None else []
                landing = ChunkExits(row["early"], drops, row["bits_in_frame"], row["min_syncs"]).step(anchor, count, 0)
                if landing is not None:
                    at = landing[0] * (row["min_syncs"] + 1) + landing[1]
                    anchor, count = row["exit_anchor"][at], row["exit_count"][at]
                elif drops:
                    count = NO_LOCK
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32()))],
                                             names=["stream_id", "chunk", "in_anchor", "in_count"])

    return summaries.repartition("stream_id").sortWithinPartitions("stream_id", "chunk").mapInArrow(
        run, "stream_id string, chunk long, in_anchor long, in_count int")


def _fold_chunk(table: pa.Table) -> pa.Table:
    first = {c: table.column(c)[0].as_py() for c in ("stream_id", "chunk", "bits_in_frame", "min_syncs", "in_anchor", "in_count")}
    kind = table.column("kind").to_numpy()
    bit = table.column("bit").to_numpy()
    rows, _, _ = fold_hits(np.sort(bit[kind == ANCHOR]), np.sort(bit[kind == DROP]), first["bits_in_frame"],
                           first["min_syncs"], first["in_anchor"], first["in_count"])
    columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([])] * 9
    n = len(rows)
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    names = ["kind", "bit", "anchor", "prev", "count", "locked", "missed", "frame", "boundary"]
    return pa.table([pa.array([first["stream_id"]] * n, pa.string()), pa.array(np.full(n, first["chunk"], np.int64)),
                     *[c.cast(t) for c, t in zip(columns, types)]], names=["stream_id", "chunk", *names])


def _folded(hits: DataFrame, streams: DataFrame, gaps: DataFrame | None) -> DataFrame:
    events = hits.select("stream_id", "chunk", "bit", F.lit(ANCHOR).alias("kind"))
    if gaps is not None:
        events = events.unionByName(gaps.select("stream_id", "chunk", "bit", F.lit(DROP).alias("kind")))
    events = events.join(per_stream(streams.select("stream_id", F.col("bits_in_frame").cast("long"), F.col("min_syncs").cast("int"))),
                         "stream_id")
    entries = materialize(_entries(events.groupBy("stream_id", "chunk").applyInArrow(_summarise_chunk, _SUMMARY_SCHEMA)))
    folded = events.join(entries, ["stream_id", "chunk"]).groupBy("stream_id", "chunk").applyInArrow(_fold_chunk, _FOLD_SCHEMA)
    return materialize(folded)


def lock_anchors(hits: DataFrame, streams: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Honoured hits and lock drops, in order.

    Out of lock every hit is honoured; in lock only one exactly a frame after the last. On a frame boundary the count rises by
    one (from "none" to 0); off it the count restarts at 1. A frame with no hit at its end, or a recording gap (``gaps``), makes
    the count none. ``count`` (after the event) is a lock level: it rises to ``min_syncs``, where the stream is in lock, and no further. ``locked`` and
    ``missed`` are the locked bits and missed frames since the event before; ``frame`` marks a hit that completes a frame.
    """
    return _folded(hits, streams, gaps)


def lock_spans(anchors: DataFrame, chunks: DataFrame, streams: DataFrame) -> DataFrame:
    """Locked bit ranges ``[bit_from, bit_to]``: after every locking hit, up to one frame, the next event or the last bit."""
    closed = anchors.where("locked > 0").select("stream_id", (F.col("prev") + 1).alias("bit_from"),
                                                (F.col("prev") + F.col("locked")).alias("bit_to"))
    last = _last_state(anchors, chunks, streams)
    still = last.where("count >= min_syncs and last_bit > anchor").select(
        "stream_id", (F.col("anchor") + 1).alias("bit_from"),
        F.least(F.col("anchor") + F.col("bits_in_frame"), "last_bit").alias("bit_to"))
    return closed.unionByName(still)


def missed_frame_events(anchors: DataFrame, chunks: DataFrame, streams: DataFrame) -> DataFrame:
    """One row per missed frame, at the bit that proves it missing (one past the end of the frame)."""
    size = streams.select("stream_id", F.col("bits_in_frame").cast("long"))
    between = anchors.where("missed > 0").join(per_stream(size), "stream_id").select("stream_id", "prev", "missed", "bits_in_frame")
    last = _last_state(anchors, chunks, streams)
    after = last.select("stream_id", F.col("anchor").alias("prev"),
                        F.expr("(last_bit - anchor - 1) div bits_in_frame").alias("missed"), "bits_in_frame")
    return (between.unionByName(after.where("missed > 0"))
            .withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), "missed", F.lit(_MISSED_STRIDE).cast("long"))))
            .withColumn("j", F.explode(F.sequence("_from", F.least("missed", F.col("_from") + _MISSED_STRIDE - 1))))
            .select("stream_id", (F.col("prev") + F.col("j") * F.col("bits_in_frame") + 1).alias("bit")))


def _last_state(anchors: DataFrame, chunks: DataFrame, streams: DataFrame) -> DataFrame:
    end = chunks.groupBy("stream_id").agg((F.sum("n_bits") - 1).alias("last_bit"))
    final = anchors.groupBy("stream_id").agg(F.max_by(F.struct("anchor", "count"), F.struct("bit", "kind")).alias("s"))
    return (end.join(final, "stream_id", "left")
            .join(streams.select("stream_id", F.col("bits_in_frame").cast("long"), "min_syncs"), "stream_id")
            .select("stream_id", "last_bit", "bits_in_frame", "min_syncs",
                    F.coalesce("s.anchor", F.lit(-1)).alias("anchor"), F.coalesce("s.count", F.lit(NO_LOCK)).alias("count")))


def stream_outcome(packets: DataFrame, hits: DataFrame, anchors: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Totals per stream and the verdict: ``no_sync``, ``sync_no_frames`` or ``ok``. Streams succeed or fail on their own."""
    size = packets.groupBy("stream_id").agg(F.count(F.lit(1)).alias("packets"),
                                            F.expr("sum((n_bits + 7) div 8)").alias("bytes"))
    found = hits.groupBy("stream_id").agg(F.count(F.lit(1)).alias("syncs"))
    folded = anchors.groupBy("stream_id").agg(F.count_if("boundary").alias("boundary_syncs"), F.count_if("frame").alias("frames"))
    out = size.join(found, "stream_id", "left").join(folded, "stream_id", "left")
    counts = ["syncs", "boundary_syncs", "frames"]
    if samples is not None:
        out = out.join(samples.groupBy("stream_id").agg(F.count(F.lit(1)).alias("samples")), "stream_id", "left")
        counts.append("samples")
    return out.na.fill(0, counts).withColumn(
        "verdict", F.when(F.col("syncs") == 0, "no_sync").when(F.col("frames") == 0, "sync_no_frames").otherwise("ok"))


def run_succeeded(outcome: DataFrame) -> DataFrame:
    """One row for the run: it succeeded if any stream did."""
    return outcome.agg(F.coalesce(F.bool_or(F.col("verdict") == "ok"), F.lit(False)).alias("success"),
                       F.count(F.lit(1)).alias("streams"), F.count_if(F.col("verdict") == "ok").alias("ok_streams"))
