"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network with calibrated temperature.

Every token bucket has a sparse random index vector; its word vector is the sum of the index vectors of its neighbours over the whole
corpus, added up in Spark (one partial sum per task, then a sum per bucket). A document is the mean and the spread of its tokens' word
vectors. The network learns from at most ``MOST_LABELS`` labelled rows; its temperature is set on a part of them that it has not seen.

Edge cases: null and empty texts have the zero vector and get the network's score for it; with labels of one kind only (or none) every
score is that label (or 0.5); repeated rows give repeated rows; an empty table gives none. A null id's text is counted and scored, but never labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.chars import OTHER, Words, mix
from lockstep.llm.common import batches_of, labels_of, materialize, prepared, strings, with_fields

#: Token buckets and the length of word vectors.
BUCKETS, WIDTH = 4096, 32
#: Non-zero items of an index vector; neighbours on each side.
NONZERO, REACH = 4, 2
#: Most labelled rows that are learned from.
MOST_LABELS = 6000
HIDDEN = 24


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every token. Capital words, repeats of the word before and runs of signs have buckets of their own."""
    words = Words(texts)
    h = words.hash.copy()
    repeat = np.zeros(len(h), bool)
    same_text = words.text[1:] == words.text[:-1]
    repeat[1:] = same_text & (h[1:] == h[:-1])
    h[words.capital & (words.length > 2)] = np.uint64(1)
    h[repeat & (words.kind != OTHER)] = np.uint64(2)
    return words.text, (mix(h, 3) % np.uint64(BUCKETS)).astype(np.int64)


def index_vectors(seed: int = 9) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for row in out:
        row[rng.choice(WIDTH, NONZERO, replace=False)] = rng.permutation([1, 1, -1, -1])
    return out


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Word vectors of all buckets from every row of ``docs``: centred and of length one; zero for buckets that do not occur."""
    prepared(docs.sparkSession)
    ddl = "bucket int, n long, " + ", ".join(f"v{i} long" for i in range(WIDTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total, n = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = strings(batch.column(0))
            for a, b in batches_of(texts):
                row, bucket = tokens(texts[a:b])
                if not len(row):
                    continue
                vectors = index[bucket]
                near = np.zeros_like(vectors)
                for k in range(1, REACH + 1):
                    same = (row[k:] == row[:-k])[:, None]
                    near[k:] += vectors[:-k] * same
                    near[:-k] += vectors[k:] * same
                order = np.argsort(bucket, kind="stable")
                ordered = bucket[order]
                first = np.flatnonzero(np.diff(ordered, prepend=-1))
                total[ordered[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.float64)
                n += np.bincount(bucket, minlength=BUCKETS)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there]), *(pa.array(total[there, i].astype(np.int64)) for i in range(WIDTH))],
                                         names=["bucket", "n", *(f"v{i}" for i in range(WIDTH))])

    rows = (docs.select(text).mapInArrow(run, ddl).groupBy("bucket")
            .agg(F.sum("n").alias("n"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDTH))).toPandas())  # at most BUCKETS rows
    out = np.zeros((BUCKETS, WIDTH))
    if len(rows):
        n = rows.n.to_numpy(float)
        v = rows[[f"v{i}" for i in range(WIDTH)]].to_numpy(float) / n[:, None]
        v -= (v * n[:, None]).sum(0) / n.sum()
        out[rows.bucket.to_numpy()] = v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    return out.astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of every text."""
    row, bucket = tokens(texts)
    out = np.zeros((len(texts), 2 * WIDTH), np.float32)
    if not len(row):
        return out
    first = np.flatnonzero(np.diff(row, prepend=-1))
    n = np.diff(np.append(first, len(row)))[:, None]
    v = vectors[bucket].astype(np.float64)
    mean = np.add.reduceat(v, first, axis=0) / n
    spread = np.sqrt(np.maximum(0, np.add.reduceat(v * v, first, axis=0) / n - mean**2))
    out[row[first]] = np.hstack([mean, spread])
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float
    constant: float = 0.5

    def score(self, texts: list[str]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-logits((pooled(texts, self.vectors) - self.centre) / self.scale, self.layers) / self.temperature))


def logits(x: np.ndarray, layers: tuple) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.clip(np.tanh(x @ w1 + b1) @ w2 + b2, -60, 60)


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 1500, seed: int = 2) -> tuple:
    """Two layers by Adam on minibatches that hold both kinds alike; the offset then restores the kinds' shares."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    kinds = [np.flatnonzero(y == k) for k in (0, 1)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(k, 64) for k in kinds])
        xb, yb = x[pick], y[pick]
        h = np.tanh(xb @ p[0] + p[1])
        slope = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - yb) / len(pick)
        back = np.outer(slope, p[2]) * (1 - h * h)
        grads = [xb.T @ back + 1e-4 * p[0], back.sum(0), h.T @ slope + 1e-4 * p[2], np.array([slope.sum()])]
        rate = 0.02 * (1 - step / steps) + 0.0005
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows the network has not seen."""
    def loss(t: float) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -z, z) / t).mean())
    return min((float(t) for t in np.geomspace(0.25, 8, 41)), key=loss)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          most_labels: int = MOST_LABELS) -> QualityModel:
    """Word vectors from all ``docs``; the network from at most ``most_labels`` labelled ones; the caller has limited ``labels`` to its fold."""
    vectors = word_vectors(docs, text)
    picked = materialize(labels_of(docs, labels, key, label).groupBy("key").agg(F.max("label").alias("y"))
                        .orderBy(F.xxhash64("key", F.lit(23)), "key").limit(most_labels))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key").select("key", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(2))
            for a, b in batches_of(texts):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in pooled(texts[a:b], vectors)], pa.binary())],
                                                 names=["y", "x"])

    got = rows.mapInArrow(run, "y int, x binary").toPandas().sort_values(["y", "x"])
    y = got.y.to_numpy(float)
    if len(set(y)) < 2 or min((y == 0).sum(), (y == 1).sum()) < 4:
        return QualityModel(vectors, np.zeros(1), np.ones(1), None, 1.0, float(y.mean().round()) if len(y) else 0.5)
    x = np.stack([np.frombuffer(r, np.float32) for r in got.x]).astype(float)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - centre) / scale
    unseen = np.arange(len(y)) % 5 == 4
    layers = fit_network(x[~unseen], y[~unseen])
    return QualityModel(vectors, centre, scale, layers, best_temperature(logits(x[unseen], layers), y[unseen]))


def score(df: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every row's whole text."""
    prepared(df.sparkSession)
    schema = with_fields(df.select(*keep), f"{name} double")
    at = list(keep).index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(at))
            for a, b in batches_of(texts):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:len(keep)]), pa.array(model.score(texts[a:b]))], names=schema.names)

    return df.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)
