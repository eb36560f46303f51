"""Exact top-k by integer inner product with KD-trees per shard.

Vectors are dealt into shards of at most about ``SHARD_ROWS`` rows; a task builds each shard's KD-tree (median splits of the widest side,
tight bounding boxes) into one row. Queries are dealt into blocks of ``QUERY_BLOCK``. Every block meets every shard, block by block: a
stated query set against all rows. Within a task a block keeps its k best across the shards it meets, so the kth score found so far
prunes the next shard; boxes are visited best first by their largest possible product with a query. A last window keeps k per query.

``x`` becomes ``floor(1024 x)``. Products are exact: shards whose products could leave the exact range of doubles are multiplied as Python
integers; scores must fit a long.

Edge cases: a vector that is null, empty of items, or holds a null or non-finite item takes no part, as query or candidate; vectors of
another length than the query's are no candidates for it; rows with the query's id are never its candidates; equal scores go to the
smaller id; repeated rows of one id count once each. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.common import materialize, prepared

SCALE = 1024
#: Rows of a shard, of a tree's leaf, and of a block of queries.
SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 16_384, 128, 512
#: Shards that one task meets with a block, one after the other.
SHARD_CHAIN = 16
#: Sums up to this stay exact in doubles.
EXACT = float(2**53)


def usable(vector: Column) -> Column:
    """Present, not empty, and every item a finite number."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


class Tree:
    """A KD-tree over one shard: boxes of all nodes as arrays, rows reordered so that a leaf is a range."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.range, self.child = [], [], [], []
        pending = [(0, len(ids), -1, 0)]
        while pending:
            a, b, parent, side = pending.pop()
            node = len(self.range)
            if parent >= 0:
                self.child[parent][side] = node
            rows = points[order[a:b]]
            low, high = rows.min(0), rows.max(0)
            self.low.append(low)
            self.high.append(high)
            self.range.append((a, b))
            self.child.append([-1, -1])
            if b - a > LEAF_ROWS and (high > low).any():
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, int((high - low).argmax())], middle)]
                pending += [(a + middle, b, node, 1), (a, a + middle, node, 0)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.points = ids[order], points[order]

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest product each node's box allows."""
        return np.maximum(query, 0) @ self.high.T + np.minimum(query, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """Best-first; ``best`` is a heap of (score, -id) and may hold results of other shards."""
        exact = query.dtype == object
        waiting = [(-bound[0], 0)]
        while waiting:
            top, node = heapq.heappop(waiting)
            if len(best) == k and -top < best[0][0]:
                return
            children = self.child[node]
            if children[0] >= 0:
                for c in children:
                    if len(best) < k or bound[c] >= best[0][0]:
                        heapq.heappush(waiting, (-bound[c], c))
                continue
            a, b = self.range[node]
            score, ids = self.points[a:b] @ query, self.ids[a:b]
            other = ids != own  # before the trim: the query's own rows must not take places among the leaf's k
            likely = np.flatnonzero(other & (score >= best[0][0]) if len(best) == k else other)
            if len(likely) > k and not exact:  # no more than k of a leaf can stay, with ties
                likely = likely[score[likely] >= np.partition(score[likely], len(likely) - k)[len(likely) - k]]
            for i in likely:
                entry = (int(score[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    x = np.floor(SCALE * np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)).reshape(-1, width)
    if len(x) and np.abs(x).max() ** 2 * width >= EXACT:
        return np.array([[int(v) for v in row] for row in x], object)
    return x


def _packed(rows: DataFrame, size: int, build, kind: str) -> DataFrame:
    """Rows of (id, vector) as one binary row per at most ``size`` rows of the same vector length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def flush(width: int) -> pa.RecordBatch:
            ids, points = (np.concatenate(x) for x in zip(*waiting.pop(width), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([pickle.dumps(build(ids, points))], pa.binary())], names=["width", kind])

        for batch in batches:
            vectors = batch.column(1)
            widths = np.array([len(v) for v in vectors], np.int64)
            for width in np.unique(widths).tolist():
                at = pa.array(np.flatnonzero(widths == width))
                waiting.setdefault(width, []).append((batch.column(0).take(at).to_numpy(), _matrix(vectors.take(at))))
                if sum(len(x[0]) for x in waiting[width]) >= size:
                    yield flush(width)
        for width in list(waiting):
            yield flush(width)

    return rows.mapInArrow(run, f"width int, {kind} binary")


def top_k(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best other rows of every row for which ``is_query`` holds."""
    spark = prepared(df.sparkSession)
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull())
    pair = [F.col(key).cast("long").alias("id"), F.col(vector).alias("v")]
    candidates = rows.select(*pair)
    asked = rows.where(is_query).select(*pair).dropDuplicates()
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    n = candidates.count()
    shards = materialize(_packed(candidates.repartition(max(1, min(tasks, -(-n // LEAF_ROWS // 8)) if n < tasks * SHARD_ROWS else -(-n // SHARD_ROWS))), SHARD_ROWS, Tree, "tree")
                         .withColumn("shard", F.monotonically_increasing_id()))
    blocks = materialize(_packed(asked.repartition(max(1, -(-n // (100 * QUERY_BLOCK)))), QUERY_BLOCK, lambda ids, points: (ids, points), "block")
                         .withColumn("query", F.monotonically_increasing_id()))
    # whole blocks meet whole shards: few rows, and the product is the stated queries against all rows
    chain = F.pmod(F.xxhash64("shard"), F.lit(max(1, -(-shards.count() // SHARD_CHAIN)) if n >= tasks * SHARD_ROWS else tasks))
    met = (blocks.withColumnRenamed("width", "query_width").join(shards, F.col("query_width") == F.col("width"))
           .withColumn("chain", chain).repartition("query", "chain").sortWithinPartitions("query", "chain", "shard").select("query", "chain", "block", "tree"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, points, best = None, None, None, []

        def out() -> pa.RecordBatch:
            flat = [(int(q), -i, s) for q, found in zip(ids, best, strict=True) for s, i in found]
            return pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for query, chained, block, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (query, chained):
                    if now is not None:
                        yield out()
                    now, (ids, points) = (query, chained), pickle.loads(block)
                    best = [[] for _ in ids]
                shard: Tree = pickle.loads(tree)
                wide = points.dtype == object or shard.points.dtype == object or float(np.abs(points).max()) * float(np.abs(shard.points).max()) * points.shape[1] >= EXACT
                if wide:
                    ints = np.vectorize(int, otypes=[object])
                    shard.points, shard.low, shard.high, asked_points = ints(shard.points), ints(shard.low), ints(shard.high), ints(points)
                else:
                    asked_points = points
                bounds = shard.bounds(asked_points)
                for i, own in enumerate(ids.tolist()):
                    shard.search(own, asked_points[i], bounds[i], k, best[i])
        if now is not None:
            yield out()

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
