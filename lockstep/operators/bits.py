"""Bit-level transforms and the frame-sync search, data-parallel over chunks of packets.

Packets here have ``stream_id, ord, chunk, n_bits, payload``: ``ord`` is the order within the stream and ``chunk`` an
order-preserving cut of it (a file-offset range, say) whose payload is small enough for one task. The payload is shuffled once,
by (stream, chunk); what crosses chunk borders is a few bits per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lockstep.functions import bits as kernels
from lockstep.functions import words
from lockstep.operators.scans import Carry, cut_at, ordered_scan, per_stream, quantile_bounds
from lockstep.session import brief_shuffles, materialize

SEARCH_COLUMNS = ["pattern", "mask", "sync_len", "swap_bytes", "inverted", "randomized"]


# --- transforms of one payload -------------------------------------------------------------------------------------

def _rewritten(payload: pa.Array, change) -> pa.Array:
    """The payloads after one numpy operation on the bytes of all of them; lengths and nulls stay."""
    if not len(payload):
        return payload
    valid, places, data = payload.buffers()
    offsets = np.frombuffer(places, np.int32)[payload.offset: payload.offset + len(payload) + 1]
    joined = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    known = None if not payload.null_count else pa.py_buffer(np.packbits(payload.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
    changed = np.ascontiguousarray(change(joined, offsets))
    return pa.Array.from_buffers(pa.binary(), len(payload), [known, pa.py_buffer(offsets), pa.py_buffer(changed)], payload.null_count)


#: Bytes swapped at a time: their places take some forty bytes each, and a batch holds thousands of payloads.
_SWAP_BYTES = 1 << 18


def _swapped(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out, first = data.copy(), 0
    while first < offsets.size - 1:
        last = max(first + 1, int(np.searchsorted(offsets, int(offsets[first]) + _SWAP_BYTES, "right")) - 1)
        begin, end = offsets[first], offsets[last]
        if last == first + 1:
            out[begin:end] = kernels.swap_pairs(data[begin:end])
        else:
            length = np.diff(offsets[first: last + 1])
            at = np.arange(end - begin)
            start, even = np.repeat(offsets[first:last] - begin, length), np.repeat(length % 2 == 0, length)
            out[begin:end] = data[begin:end][np.where(even, start + ((at - start) ^ 1), at)]
        first = last
    return out


@F.arrow_udf(BinaryType())
def _swap(payload: pa.Array) -> pa.Array:
    return _rewritten(payload, _swapped)


@F.arrow_udf(BinaryType())
def _invert(payload: pa.Array) -> pa.Array:
    return _rewritten(payload, lambda data, _: ~data)


@F.arrow_udf(BinaryType())
def _reverse(payload: pa.Array) -> pa.Array:
    return _rewritten(payload, lambda data, _: kernels.reverse_each_byte(data))


def swap_bytes(packets: DataFrame) -> DataFrame:
    """Exchange adjacent bytes, per packet; an odd-length payload is left alone and flagged ``swap_skipped``."""
    return packets.withColumns({"swap_skipped": F.octet_length("payload") % 2 == 1, "payload": _swap("payload")})


def invert_bits(packets: DataFrame) -> DataFrame:
    return packets.withColumn("payload", _invert("payload"))


def reverse_bits(packets: DataFrame) -> DataFrame:
    """Least-significant-bit-first payloads read as most-significant-first."""
    return packets.withColumn("payload", _reverse("payload"))


def swap_report(packets: DataFrame, key: str = "stream_id") -> DataFrame:
    """Per stream: packets, packets an odd length kept unswapped, and what that means for the byte order."""
    odd = F.count_if(F.octet_length("payload") % 2 == 1)
    return (packets.groupBy(key).agg(F.count(F.lit(1)).alias("packets"), odd.alias("skipped"))
            .withColumn("byte_order", F.when(F.col("skipped") == 0, "swapped")
                        .when(F.col("skipped") == F.col("packets"), "all_odd").otherwise("mixed")))


# --- chunks and their borders --------------------------------------------------------------------------------------

def chunk_table(edges: DataFrame) -> DataFrame:
    """Per chunk (``stream_id, chunk, n_bits, tail``): where it starts and the bits just before it.

    One small row per chunk; a chunk holds at least one bit, so the last HISTORY_BITS chunks hold the history.
    """
    order = W.partitionBy("stream_id").orderBy("chunk")
    near = order.rowsBetween(-kernels.HISTORY_BITS, -1)
    return edges.withColumns({
        "chunk_no": F.row_number().over(order).cast("long"),
        "chunk_base": F.coalesce(F.sum("n_bits").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "history": F.right(F.array_join(F.collect_list("tail").over(near), ""), F.lit(kernels.HISTORY_BITS)),
    })


def payload_edges(packets: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """First and last bits of every chunk, from the ends of its packets only: the payloads themselves are not shuffled."""
    ends = packets.select("stream_id", "chunk", "ord", "n_bits", F.octet_length("payload").alias("n_bytes"),
                          F.substring("payload", 1, 12).alias("front"), F.substring("payload", -12, 12).alias("back"))
    if streams is not None:
        ends = ends.join(per_stream(streams.select("stream_id", "swap_bytes", "inverted")), "stream_id")
    else:
        ends = ends.withColumns({"swap_bytes": F.lit(False), "inverted": F.lit(False)})
    return ends.groupBy("stream_id", "chunk").applyInArrow(
        _edge_rows, "stream_id string, chunk long, n_bits long, head string, tail string")


def _edge_rows(table: pa.Table) -> pa.Table:
    table = table.sort_by("ord")
    cols = {name: table.column(name).to_pylist() for name in ("n_bits", "n_bytes", "front", "back")}
    swap, invert = table.column("swap_bytes")[0].as_py(), table.column("inverted")[0].as_py()

    def piece(raw: bytes, n_bytes: int) -> np.ndarray:
        return kernels.condition(raw, swap and n_bytes % 2 == 0, invert)

    head, tail = "", ""
    for n, size, raw in zip(cols["n_bits"], cols["n_bytes"], cols["front"]):
        head += kernels.head_bits(piece(raw, size), n)
        if len(head) >= kernels.HISTORY_BITS:
            break
    for n, size, raw in zip(reversed(cols["n_bits"]), reversed(cols["n_bytes"]), reversed(cols["back"])):
        part = piece(raw, size)
        tail = kernels.tail_bits(part, n - 8 * (size - part.size)) + tail
        if len(tail) >= kernels.HISTORY_BITS:
            break
    return pa.table({"stream_id": [table.column("stream_id")[0].as_py()], "chunk": [table.column("chunk")[0].as_py()],
                     "n_bits": [sum(cols["n_bits"])], "head": [head[: kernels.HISTORY_BITS]],
                     "tail": [tail[-kernels.HISTORY_BITS:]]})


def _joined_bits(table: pa.Table) -> tuple[np.ndarray, int]:
    table = table.sort_by("ord")
    swap, invert = table.column("swap_bytes")[0].as_py(), table.column("inverted")[0].as_py()
    parts = [kernels.condition(b.as_buffer(), swap, invert) for chunk in table.column("payload").chunks for b in chunk]
    return kernels.concat_bits(parts, table.column("n_bits").to_pylist())


# --- descrambling ---------------------------------------------------------------------------------------------------

def derandomize(packets: DataFrame) -> DataFrame:
    """Descramble whole streams: each packet's payload with the scrambler's memory carried over packet borders."""
    chunks = chunk_table(payload_edges(packets)).select("stream_id", "chunk", "history")
    slim = packets.select("stream_id", "ord", "chunk", "n_bits", "payload")
    return slim.groupBy("stream_id", "chunk").cogroup(chunks.groupBy("stream_id", "chunk")).applyInArrow(
        _descrambled, "stream_id string, ord long, chunk long, n_bits long, payload binary")


def _descrambled(packets: pa.Table, chunk: pa.Table) -> pa.Table:
    packets = packets.sort_by("ord")
    sizes = packets.column("n_bits").to_pylist()
    parts = [np.frombuffer(b, np.uint8) for b in packets.column("payload").to_pylist()]
    packed, total = kernels.concat_bits(parts, sizes)
    plain = kernels.with_history(packed, total, chunk.column("history")[0].as_py(), True)[kernels.HISTORY_BITS // 8:]
    if all(n % 8 == 0 for n in sizes):
        cuts = np.cumsum([0, *[n // 8 for n in sizes]])
        out = [plain[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    else:
        bits = np.unpackbits(plain)
        cuts = np.cumsum([0, *sizes])
        out = [np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return packets.set_column(packets.schema.get_field_index("payload"), "payload", pa.array(out, pa.binary()))


# --- sync search ------------------------------------------------------------------------------------------------------

_SCAN_SCHEMA = "stream_id string, chunk long, variant int, bit long, n_bits long, head string, tail string"


def _scan_table(stream: str, chunk: int, variants: list[int], hits: list[np.ndarray], edges: list[tuple]) -> pa.Table:
    """Hit rows (``bit`` set, relative to the chunk) and one edge row per variant (``bit`` null)."""
    sizes = [h.size for h in hits]
    n = sum(sizes)
    tags = np.concatenate([np.repeat(np.int32(v), s) for v, s in zip(variants, sizes)]).astype(np.int32)
    bit = np.concatenate(hits).astype(np.int64)
    pad = len(edges)
    return pa.table({
        "stream_id": pa.array([stream] * (n + pad), pa.string()),
        "chunk": pa.array(np.full(n + pad, chunk, np.int64)),
        "variant": pa.array(np.concatenate([tags, np.asarray(variants[:pad], np.int32)])),
        "bit": pa.concat_arrays([pa.array(bit), pa.nulls(pad, pa.int64())]),
        "n_bits": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([e[0] for e in edges], pa.int64())]),
        "head": pa.concat_arrays([pa.nulls(n, pa.string()), pa.array([e[1] for e in edges], pa.string())]),
        "tail": pa.concat_arrays([pa.nulls(n, pa.string()), pa.array([e[2] for e in edges], pa.string())]),
    })


def _scan_chunk(table: pa.Table) -> pa.Table:
    first = {c: table.column(c)[0].as_py() for c in ("stream_id", "chunk", *SEARCH_COLUMNS)}
    packed, total = _joined_bits(table)
    plain = kernels.with_history(packed, total, "", first["randomized"])
    hits = kernels.find_pattern(plain, total, first["pattern"], first["mask"])
    hits = hits[hits >= kernels.HISTORY_BITS]
    edge = (total, kernels.head_bits(packed, total), kernels.tail_bits(packed, total))
    return _scan_table(first["stream_id"], first["chunk"], [0], [hits], [edge])


def _seam_hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hits in a chunk's first bits, which need the bits before the chunk."""
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            head = kernels.from_text(r.head)
            plain = kernels.with_history(np.packbits(head), head.size, r.history, r.randomized, r.lsb_first)
            found = kernels.find_pattern(plain, head.size, r.pattern, r.mask)
            rows.extend((r.stream_id, r.chunk, r.variant, int(p)) for p in found)
        yield pd.DataFrame(rows, columns=["stream_id", "chunk", "variant", "bit"])


def _assemble(scan: DataFrame, settings: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits at stream bit offsets, and the chunk table, from a materialized scan."""
    edges = scan.where(F.col("bit").isNull()).drop("bit")
    chunks = chunk_table(edges.where(F.col("variant") == 0)) if keys == ["stream_id"] else _variant_chunks(edges)
    seam = (chunks.join(per_stream(settings), keys)
            .select("stream_id", "chunk", "variant", "head", "history", "pattern", "mask", "randomized", "lsb_first")
            .mapInPandas(_seam_hits, "stream_id string, chunk long, variant int, bit long"))
    inside = scan.where(F.col("bit").isNotNull()).select("stream_id", "chunk", "variant", "bit")
    base = chunks.select("stream_id", "variant", "chunk", "chunk_base")
    hits = (inside.unionByName(seam).join(base, ["stream_id", "variant", "chunk"])
            .join(per_stream(settings.select(*keys, "sync_len")), keys)
            .withColumn("bit", F.col("bit") + F.col("chunk_base"))
            .where(F.col("bit") >= F.col("sync_len") - 1))
    return hits, chunks


def _variant_chunks(edges: DataFrame) -> DataFrame:
    keyed = edges.withColumn("stream_id", F.concat_ws("\u0001", "stream_id", F.col("variant").cast("string")))
    return chunk_table(keyed).withColumn("stream_id", F.split_part("stream_id", F.lit("\u0001"), F.lit(1)))


def scan_packets(packets: DataFrame, streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sync_hits`` and the chunk table together: the payloads are read, shuffled and searched once, then written."""
    slim = packets.select("stream_id", "ord", "chunk", "n_bits", "payload")
    joined = slim.join(per_stream(streams.select("stream_id", *SEARCH_COLUMNS)), "stream_id")
    scan = materialize(joined.groupBy("stream_id", "chunk").applyInArrow(_scan_chunk, _SCAN_SCHEMA))
    settings = streams.select("stream_id", "pattern", "mask", "sync_len", "randomized", F.lit(False).alias("lsb_first"))
    hits, chunks = _assemble(scan, settings, ["stream_id"])
    return hits.select("stream_id", "chunk", "bit"), chunks.drop("variant")


def sync_hits(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Every stream bit offset (of the pattern's last bit) where the last 64 bits under the mask equal the pattern."""
    return scan_packets(packets, streams)[0]


# --- diagnosis: which transform, which frame length, which pattern -----------------------------------------------------

_MATRIX = [(swap, invert, randomized, lsb) for swap in (False, True) for invert in (False, True)
           for randomized in (False, True) for lsb in (False, True)]


def _scan_variants(table: pa.Table) -> pa.Table:
    table = table.sort_by("ord")
    first = {c: table.column(c)[0].as_py() for c in ("stream_id", "chunk", "pattern", "mask")}
    payloads = table.column("payload").to_pylist()
    sizes = table.column("n_bits").to_pylist()
    hits, edges = [], []
    for swap, invert, randomized, lsb in _MATRIX:
        packed, total = kernels.concat_bits([kernels.condition(b, swap, invert) for b in payloads], sizes)
        found = kernels.find_pattern(kernels.with_history(packed, total, "", randomized, lsb), total,
                                     first["pattern"], first["mask"])
        hits.append(found[found >= kernels.HISTORY_BITS])
        edges.append((total, kernels.head_bits(packed, total), kernels.tail_bits(packed, total)))
    return _scan_table(first["stream_id"], first["chunk"], list(range(len(_MATRIX))), hits, edges)


def transform_matrix(packets: DataFrame, streams: DataFrame, frame_bits: int | None = None) -> DataFrame:
    """All sixteen combinations of swap, inversion, descrambling and bit order, with their hits and the share on one grid.

    The payload is shuffled once; the combinations are tried on it in place. ``rank`` 1 is the best of a stream.
    """
    slim = packets.select("stream_id", "ord", "chunk", "n_bits", "payload")
    joined = slim.join(per_stream(streams.select("stream_id", "pattern", "mask")), "stream_id")
    scan = materialize(joined.groupBy("stream_id", "chunk").applyInArrow(_scan_variants, _SCAN_SCHEMA))
    spark = packets.sparkSession
    matrix = spark.createDataFrame([(i, *row) for i, row in enumerate(_MATRIX)],
                                   "variant int, swap boolean, invert boolean, randomized boolean, lsb_first boolean")
    tried = F.explode(F.sequence(F.lit(0), F.lit(len(_MATRIX) - 1))).alias("variant")
    settings = (streams.select("stream_id", "pattern", "mask", "sync_len", tried)
                .join(matrix.select("variant", "randomized", "lsb_first"), "variant"))
    hits, chunks = _assemble(scan, settings, ["stream_id", "variant"])
    per = hits.groupBy("stream_id", "variant").agg(F.count(F.lit(1)).alias("hits"))
    grid = hit_grid(hits, frame_bits, keys=["stream_id", "variant"])
    best = W.partitionBy("stream_id").orderBy(F.desc("on_grid"), F.desc("hits"), "variant")
    return (settings.select("stream_id", "variant").join(matrix, "variant")
            .join(per, ["stream_id", "variant"], "left").join(grid, ["stream_id", "variant"], "left")
            .select("stream_id", "variant", "swap", "invert", "randomized", "lsb_first",
                    F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("on_grid", F.lit(0)).alias("on_grid"), "period")
            .withColumn("rank", F.row_number().over(best)))


def hit_grid(hits: DataFrame, frame_bits: int | None = None, keys: list[str] | None = None,
             bit: str = "bit", chunk: Column | str | None = "chunk", candidates: int = 5) -> DataFrame:
    """The hit spacing that most hits share: tried are the ``candidates`` commonest spacings (or ``frame_bits`` alone), listed in
    ``top_deltas``, and the best is the one with the most hits in one residue class. Fewer than two hits: no grid."""
    keys = keys or ["stream_id"]
    chunk = F.col(chunk) if isinstance(chunk, str) else chunk
    slim = hits.select(*keys, F.col(bit).alias("_bit"), *([chunk.alias("_cut")] if chunk is not None else []))
    spaced = ordered_scan(slim, keys, ["_bit"], [Carry("_prev", F.col("_bit"), "last", inclusive=False)],
                          F.col("_cut") if chunk is not None else None)
    deltas = (spaced.where(F.col("_prev").isNotNull()).withColumn("delta", F.col("_bit") - F.col("_prev"))
              .groupBy(*keys, "delta").agg(F.count(F.lit(1)).alias("n"), F.min("_bit").alias("_seen")))
    ranked = deltas.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "_seen")))
    top = ranked.where(F.col("place") <= candidates)
    tops = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "delta", "n"))).alias("top_deltas"))
    periods = (top.where("delta > 0").select(*keys, "place", F.col("delta").alias("period")) if frame_bits is None
               else tops.select(*keys, F.lit(1).alias("place"), F.lit(frame_bits).cast("long").alias("period")))
    shared = (slim.join(per_stream(periods), keys).groupBy(*keys, "place", "period", F.expr("pmod(_bit, period)").alias("residue"))
              .agg(F.count(F.lit(1)).alias("n"))
              .groupBy(*keys, "place", "period").agg(F.max("n").alias("on_grid")))
    best = shared.groupBy(*keys).agg(F.max_by(F.struct("period", "on_grid"), F.struct("on_grid", -F.col("place"))).alias("b"))
    return best.select(*keys, "b.period", "b.on_grid").join(tops, keys, "left")


_PIECE_COLUMNS = {"words": np.uint64, "buckets": np.uint8, "counts": np.uint32, "starts": np.uint32, "run_at": np.uint32, "run_step": np.uint32, "run_n": np.uint32}
#: Of them, those that are packed, and whether they rise (by and large).
_PACKED = {"words": True, "buckets": True, "counts": False, "starts": True}
#: Bits of a stream for one part of its words, which one task holds packed.
PART_BITS = 1 << 24
#: Turns in which the parts are made: the files of one are gone before the next.
TURNS = 3


def _binaries(values: np.ndarray, cuts: np.ndarray, column: str) -> pa.Array:
    """The ranges of ``values`` between ``cuts`` as binary values."""
    data = np.ascontiguousarray(values.astype(_PIECE_COLUMNS[column]))
    if column in _PACKED:
        return pa.array([words.squeezed(data[a:b], _PACKED[column]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.binary())
    return pa.Array.from_buffers(pa.binary(), cuts.size - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _values(column: pa.ChunkedArray, name: str) -> list[np.ndarray]:
    kind = _PIECE_COLUMNS[name]
    if name in _PACKED:
        return [words.released(b.as_buffer().to_pybytes(), kind, _PACKED[name]) for chunk in column.chunks for b in chunk]
    return [np.frombuffer(b.as_buffer(), kind) for chunk in column.chunks for b in chunk]


def _word_pieces(length: int, levels: np.ndarray | None = None, turn: int = 0, turns: int = 1):
    """Per slice of a chunk and part of the words: where each word of the part starts. A word belongs to the chunk that its last bit is in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("ord")
        stream, base, history, parts = (table.column(c)[0].as_py() for c in ("stream_id", "chunk_base", "history", "parts"))
        payloads = [np.frombuffer(b.as_buffer(), np.uint8) for chunk in table.column("payload").chunks for b in chunk]
        packed, total = kernels.concat_bits(payloads, table.column("n_bits").to_pylist())
        for begin, bits in words.slices(packed, total, kernels.from_text(history or ""), length):
            *values, word_cuts, start_cuts, run_cuts = words.word_starts(bits, length, parts, levels, turn, turns)
            some = np.flatnonzero(np.diff(word_cuts))
            cuts = dict(zip(_PIECE_COLUMNS, (word_cuts, word_cuts, word_cuts, start_cuts, run_cuts, run_cuts, run_cuts), strict=True))
            batch = pa.RecordBatch.from_arrays(
                [pa.array([stream] * parts, pa.string()), pa.array(np.arange(parts, dtype=np.int64)), pa.array(np.full(parts, base + begin, np.int64)),
                 *(_binaries(v, cuts[c], c) for v, c in zip(values, _PIECE_COLUMNS, strict=True))],
                names=["stream_id", "part", "base", *_PIECE_COLUMNS])
            yield batch.take(pa.array(some))

    return run


def _spaced(length: int, min_reps: int):
    """The words of one part that repeat at one distance, from the pieces of all chunks. They are unfolded and looked at bucket by bucket."""
    def run(table: pa.Table) -> pa.Table:
        columns = {c: _values(table.column(c), c) for c in _PIECE_COLUMNS}
        entries = np.cumsum([0, *(s.size for s in columns["starts"])])
        bases = table.column("base").to_numpy()
        runs = np.concatenate([a + e for a, e in zip(columns["run_at"], entries, strict=False)]).astype(np.int64)
        n, step = np.ones(entries[-1], np.int32), np.zeros(entries[-1], np.int32)
        n[runs], step[runs] = np.concatenate(columns["run_n"]), np.concatenate(columns["run_step"])
        keys, buckets = (np.concatenate([np.repeat(w, k) for w, k in zip(columns[c], columns["counts"], strict=True)]) for c in ("words", "buckets"))
        starts = np.concatenate([s + b for s, b in zip(columns.pop("starts"), bases, strict=True)])
        columns.clear()
        order = np.argsort(buckets, kind="stable")
        found = []
        for at in np.split(order, np.searchsorted(buckets[order], np.arange(1, words.BUCKETS))):
            if not at.size:
                continue
            at = at[np.argsort(starts[at])]
            unique, key_of = np.unique(keys[at], return_inverse=True)
            for some in words.unfolded(unique, key_of, starts[at], n[at], step[at], length):
                found.append(words.spaced_words(*some, length, min_reps))
        word, period, hits, on_grid = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"stream_id": pa.array([table.column("stream_id")[0].as_py()] * word.size, pa.string()), "on_grid": on_grid, "word": word,
                         "period": period, "hits": hits})

    return run


def _common_pieces(packets: DataFrame, length: int, total: int) -> np.ndarray:
    """How common the pieces are that words are dealt out by: a table of one byte for each, from counts over all payloads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(words.commonness([], 1, length).size, np.int64)
        for batch in batches:
            for payload in batch.column(0):
                words.count_pieces(np.frombuffer(payload.as_buffer(), np.uint8), length, counts)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["piece", "n"])

    counts = packets.select("payload").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return words.commonness([tuple(r) for r in counts.where(F.col("n") > words.COMMON * total).collect()], total, length)


def discover_sync(packets: DataFrame, word_len: int = 32, min_reps: int = 6, part_bits: int = PART_BITS) -> DataFrame:
    """All words with at least ``min_reps`` starts, most of them one fixed distance apart; ``place`` 1 has the most starts on its grid.

    The words of a stream are cut into parts, as many as it has ``part_bits``. A chunk gives each part its stretches of neighbouring words packed,
    some three bytes for eight words; so rows leave by part, not by word, and one part is one task's. Parts are made in ``TURNS``, each of which
    reads the packets again and leaves nothing but its words on disk.
    """
    chunks = materialize(chunk_table(payload_edges(packets)).select("stream_id", "chunk", "n_bits", "history", "chunk_base"))
    total = chunks.agg(F.sum("n_bits")).first()[0] or 0
    sizes = chunks.groupBy("stream_id").agg(F.ceil(F.sum("n_bits") / part_bits).cast("int").alias("parts"))
    known = chunks.drop("n_bits").join(per_stream(sizes), "stream_id")
    ready = packets.select("stream_id", "ord", "chunk", "n_bits", "payload").join(known, ["stream_id", "chunk"])
    blobs = ", ".join(f"{c} binary" for c in _PIECE_COLUMNS)
    levels = _common_pieces(packets, word_len, total)
    tasks, made = max(1, -(-total // (TURNS * part_bits))), []
    with brief_shuffles(packets.sparkSession):
        for turn in range(TURNS):
            pieces = ready.groupBy("stream_id", "chunk").applyInArrow(_word_pieces(word_len, levels, turn, TURNS),
                                                                      f"stream_id string, part long, base long, {blobs}")
            parts = pieces.repartition(tasks, "stream_id", "part").groupBy("stream_id", "part")
            made.append(materialize(parts.applyInArrow(_spaced(word_len, min_reps), "stream_id string, on_grid long, word long, period long, hits long")))
    found = reduce(DataFrame.unionByName, made)
    order = {"_grid": -F.col("on_grid"), "_word": -F.col("word"), "_period": -F.col("period"),
             "_order": -(F.col("on_grid") + F.col("word") / F.lit(2.0 ** word_len))}
    ordered = found.withColumns(order)
    cut, chunk = cut_at(ordered, "_order", quantile_bounds(ordered, "_order"))
    placed = ordered_scan(cut, ["stream_id"], ["_grid", "_word", "_period"], [Carry("place", F.lit(1), "count")], chunk)
    return placed.select("stream_id", F.col("place").cast("int").alias("place"), "on_grid", "word", "period", "hits")
