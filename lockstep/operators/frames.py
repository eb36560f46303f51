"""Minor frames and their words: cut from the payload once the lock has said where frames are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.functions import bits as kernels
from lockstep.operators.bits import SEARCH_COLUMNS, _joined_bits
from lockstep.operators.scans import Carry, ordered_scan, per_stream


def extract_frames(anchors: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Completed frames: ``start`` (the hit before), ``end_bit`` (the hit that completed it) and, given windows, ``window_idx`` -
    a frame counts in the window of its last bit."""
    frames = anchors.where("frame").select("stream_id", "chunk", F.col("prev").alias("start"), F.col("bit").alias("end_bit"))
    if windows is None:
        return frames
    starts = windows.select("stream_id", F.col("chunk_from").alias("chunk"), F.col("bit_from").alias("_at"), F.lit(0).alias("_kind"),
                            F.col("window_idx").alias("_window"))
    both = frames.withColumns({"_at": F.col("end_bit"), "_kind": F.lit(1)}).unionByName(starts, allowMissingColumns=True)
    placed = ordered_scan(both, ["stream_id"], ["_at", "_kind"], [Carry("window_idx", F.col("_window"), "last")], F.col("chunk"))
    return placed.where("_kind = 1").select("stream_id", "chunk", "start", "end_bit", "window_idx")


def _frame_pieces(frames: DataFrame, chunks: DataFrame, word_map: DataFrame) -> DataFrame:
    """Each frame once per chunk it touches (one or two), with what the cutting needs: chunk border bits and word numbers."""
    table = chunks.select("stream_id", "chunk", "chunk_no", "chunk_base", "n_bits", "history")
    words = word_map.groupBy("stream_id").agg(F.array_sort(F.collect_set(F.col("word").cast("int"))).alias("words"))
    ends = frames.join(table.select("stream_id", "chunk", "chunk_no"), ["stream_id", "chunk"])
    keep = ["stream_id", "chunk_no", "start", "end_bit", "window_idx"]
    base = table.select("stream_id", "chunk_no", "chunk_base")
    reach = ends.join(base, ["stream_id", "chunk_no"])
    # A frame ends in its own chunk; about one per chunk starts before it. Those few, put among the chunks' own starts, say
    # which chunk they begin in.
    outside = reach.where("start + 1 < chunk_base").select(*keep, (F.col("start") + 1).alias("_at"), F.lit(1).alias("_kind"))
    starts = base.select("stream_id", F.col("chunk_base").alias("_at"), F.lit(0).alias("_kind"), F.col("chunk_no").alias("_no"))
    found = ordered_scan(outside.unionByName(starts, allowMissingColumns=True), ["stream_id"], ["_at", "_kind"],
                         [Carry("_first", F.col("_no"), "last")]).where("_kind = 1")
    earlier = found.withColumn("chunk_no", F.explode(F.sequence("_first", F.col("chunk_no") - 1)))
    return (reach.select(*keep).unionByName(earlier.select(*keep)).join(table, ["stream_id", "chunk_no"])
            .join(per_stream(words), "stream_id").drop("chunk_no"))


def _cut(packets: pa.Table, pieces: pa.Table) -> tuple | None:
    if not pieces.num_rows or not packets.num_rows:
        return None
    packed, total = _joined_bits(packets)
    lead = kernels.HISTORY_BITS // 8
    plain = kernels.with_history(packed, total, pieces.column("history")[0].as_py(), packets.column("randomized")[0].as_py())[lead:]
    words = np.asarray(pieces.column("words")[0].as_py(), np.int64)
    word_len = packets.column("word_len")[0].as_py()
    start = pieces.column("start").to_numpy() - pieces.column("chunk_base")[0].as_py()
    at = start[:, None] + 1 + word_len * words[None, :]
    return words, kernels.word_values(plain, total, at, word_len).astype(np.int64), (at > -word_len) & (at < total)


def _words_of_frames(packets: pa.Table, pieces: pa.Table) -> pa.Table:
    schema = pa.schema([("stream_id", pa.string()), ("end_bit", pa.int64()), ("window_idx", pa.int64()), ("word", pa.int32()),
                        ("part", pa.int64())])
    cut = _cut(packets, pieces)
    if cut is None:
        return schema.empty_table()
    words, values, inside = cut
    row, col = np.nonzero(inside)
    window = pieces.column("window_idx")
    return pa.table([pa.array([pieces.column("stream_id")[0].as_py()] * row.size, pa.string()),
                     pa.array(pieces.column("end_bit").to_numpy()[row]), window.take(pa.array(row)).combine_chunks(),
                     pa.array(words[col].astype(np.int32)), pa.array(values[row, col])], schema=schema)


def _sums_of_windows(packets: pa.Table, pieces: pa.Table) -> pa.Table:
    schema = pa.schema([("stream_id", pa.string()), ("window_idx", pa.int64()), ("word", pa.int32()), ("part", pa.int64())])
    cut = _cut(packets, pieces)
    if cut is None:
        return schema.empty_table()
    words, values, _ = cut
    window = pieces.column("window_idx").to_numpy()
    order = np.argsort(window, kind="stable")
    found, first = np.unique(window[order], return_index=True)
    sums = np.add.reduceat(values[order], first, axis=0)
    return pa.table([pa.array([pieces.column("stream_id")[0].as_py()] * sums.size, pa.string()),
                     pa.array(np.repeat(found, words.size)), pa.array(np.tile(words, found.size).astype(np.int32)),
                     pa.array(sums.reshape(-1))], schema=schema)


def _cogroup(packets: DataFrame, frames: DataFrame, chunks: DataFrame, streams: DataFrame, word_map: DataFrame):
    slim = (packets.select("stream_id", "ord", "chunk", "n_bits", "payload")
            .join(per_stream(streams.select("stream_id", "word_len", *SEARCH_COLUMNS)), "stream_id"))
    if "window_idx" not in frames.columns:
        frames = frames.withColumn("window_idx", F.lit(None).cast("long"))
    pieces = _frame_pieces(frames, chunks, word_map)
    return slim.groupBy("stream_id", "chunk").cogroup(pieces.groupBy("stream_id", "chunk"))


def demux_words(packets: DataFrame, frames: DataFrame, chunks: DataFrame, streams: DataFrame, word_map: DataFrame) -> DataFrame:
    """One row per frame and mapped parameter with the raw word. A word cut by a chunk border is put together from its parts."""
    parts = _cogroup(packets, frames, chunks, streams, word_map).applyInArrow(
        _words_of_frames, "stream_id string, end_bit long, window_idx long, word int, part long")
    words = parts.groupBy("stream_id", "end_bit", "window_idx", "word").agg(F.sum("part").alias("raw"))
    return words.join(per_stream(word_map.select("stream_id", "ord", "name", F.col("word").cast("int"))), ["stream_id", "word"])


def channel_window_mean(packets: DataFrame, frames: DataFrame, samples: DataFrame, chunks: DataFrame, streams: DataFrame,
                        word_map: DataFrame) -> DataFrame:
    """Mean raw count per window and parameter; 0.0 for a window no frame ended in.

    Words are summed per window where the payload is, so only (window, word) sums leave a chunk.
    """
    parts = _cogroup(packets, frames, chunks, streams, word_map).applyInArrow(
        _sums_of_windows, "stream_id string, window_idx long, word int, part long")
    sums = parts.groupBy("stream_id", "window_idx", "word").agg(F.sum("part").alias("total"))
    grid = samples.join(per_stream(word_map.select("stream_id", "ord", "name", F.col("word").cast("int"))), "stream_id")
    return (grid.join(sums, ["stream_id", "window_idx", "word"], "left")
            .withColumn("raw_mean", F.when(F.col("n_frames") > 0, F.coalesce("total", F.lit(0)) / F.col("n_frames")).otherwise(0.0))
            .select("stream_id", "window_idx", "t_abs", "n_frames", "ord", "name", "word", "raw_mean"))


def pick_words(frames: DataFrame, word_map: DataFrame, array: str = "words") -> DataFrame:
    """Frames that already hold their words as an array: one row per mapped parameter (zero-based word).

    The map is one row with an array (its entries are at most a frame's words), which every frame unrolls for itself.
    """
    whole = word_map.agg(F.collect_list(F.struct("ord", "name", "word")).alias("_map"))
    mapped = frames.join(whole, F.lit(True)).withColumn("_m", F.explode("_map")).drop("_map")
    return mapped.select(*frames.columns, "_m.*").withColumn("raw", F.try_element_at(array, F.col("word") + 1))
