"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic examples carry a label; all other text is unlabelled and holds toxic text too, in the share ``prior``. Features are
the presence of words and of word beginnings that are over-represented in the confirmed examples, against their document frequency in
the whole corpus. Several linear classifiers minimise the class-prior-corrected risk ``prior R+(positive) + max(0, R-(unlabelled) -
prior R-(positive))``; where the second part turns negative its gradient is reversed, so it cannot be overfitted. Their mean is the score.
Examples are bounded by ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` (drawn by hash of the id); counts cover every row.

Edge cases: null and empty texts have no feature and are scored as such; without confirmed examples every score is 0; repeated rows give
repeated rows; an empty table gives none. A null id is counted and scored but never an example. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.chars import WORD, Words
from lockstep.llm.common import batches_of, labels_of, materialize, prepared, strings, with_fields

#: Most rows of each sort that are learned from.
MOST_POSITIVE, MOST_UNLABELLED = 2000, 4000
#: The labelled share is raised by this much: a prior that is too low calls confirmed rows clean.
PRIOR_MARGIN = 1.15
#: Features whose corpus frequency is counted, and those that are kept.
CANDIDATES, FEATURES = 20_000, 512
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6)
#: Least confirmed documents with a feature (and their least share), and how over-represented it must be.
LEAST_DOCS, LEAST_SHARE, LEAST_LIFT = 3, 0.01, 4.0
CLASSIFIERS, TABLE_BITS = 3, 20


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all words and word beginnings, with repeats."""
    words = Words(texts, prefixes=BEGINNINGS)
    use = words.kind == WORD
    rows, hashes = [words.text[use]], [words.hash[use]]
    for n in BEGINNINGS:
        long = words.prefix[n] != 0
        rows.append(words.text[long])
        hashes.append(words.prefix[n][long])
    return np.concatenate(rows), np.concatenate(hashes)


class Lookup:
    """Places of known 64-bit hashes; everything else is dropped by one table look and one comparison."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.filter = np.zeros(1 << TABLE_BITS, bool)
        self.filter[self._slot(self.sorted)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place) pairs, by text."""
        row, h = text_features(texts)
        maybe = self.filter[self._slot(h)]
        row, h = row[maybe], h[maybe]
        at = np.minimum(np.searchsorted(self.sorted, h), max(0, len(self.sorted) - 1))
        known = self.sorted[at] == h if len(self.sorted) else np.zeros(0, bool)
        pair = np.unique(row[known] * len(self.sorted) + at[known])
        return pair // max(1, len(self.sorted)), pair % max(1, len(self.sorted))


@dataclass
class ToxicityModel:
    lookup: Lookup
    weights: np.ndarray  # classifiers by features + 1; no rows: nothing was confirmed

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        row, place = self.lookup.pairs(texts)
        z = np.stack([np.bincount(row, w[place], minlength=len(texts)) + w[-1] for w in self.weights])
        return (1 / (1 + np.exp(-np.clip(z, -60, 60)))).mean(0)


def non_negative_pu(x: np.ndarray, confirmed: np.ndarray, prior: float, steps: int = 200, seed: int = 0) -> np.ndarray:
    """A linear classifier under the non-negative risk with sigmoid loss, on a resample of both sorts (full-batch Adam)."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    xp, xu = (x[rng.choice(rows, len(rows))] if seed else x[rows] for rows in (np.flatnonzero(confirmed), np.flatnonzero(~confirmed)))
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(part @ w, -40, 40))) for part in (xp, xu))
        rest = su.mean() - prior * sp.mean()  # risk of calling unlabelled rows toxic, without the toxic ones among them
        up = xp.T @ (sp * (1 - sp)) / len(xp)
        g_rest = xu.T @ (su * (1 - su)) / len(xu) - prior * up
        g = g_rest - prior * up if rest >= 0 else -g_rest
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w.astype(float)


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """Bounded rows ``positive, text``: confirmed toxic ones, and any rows at all as unlabelled ones."""
    def first(df: DataFrame, n: int, seed: int) -> DataFrame:
        return df.distinct().orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(n)

    confirmed = first(labels.where("label = 1").select("key"), MOST_POSITIVE, 31)
    total = docs.count()
    share = min(1.0, 3 * MOST_UNLABELLED / max(1, total))  # thinned before the exact cut
    thin = docs.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.col(key), F.lit(32)), F.lit(1_000_000)) < share * 1_000_000)).select(F.col(key).alias("key"))
    ids = materialize(confirmed.withColumn("positive", F.lit(True)).unionByName(first(thin, MOST_UNLABELLED, 33).withColumn("positive", F.lit(False))))
    return materialize(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key").select("positive", "text"))


def _candidates(sample: DataFrame) -> np.ndarray:
    """Hashes over-represented in the sample's confirmed rows, the most frequent first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positive, texts = np.array(batch.column(0).to_pylist(), bool), strings(batch.column(1))
            for a, b in batches_of(texts):
                row, h = text_features(texts[a:b])
                pair = np.unique(np.stack([row.astype(np.uint64), h], 1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(positive[a:b][pair[:, 0].astype(np.int64)]), pa.array(pair[:, 1].view(np.int64))], names=["positive", "h"])

    size = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_pos, n_unl = size.get(True, 0), size.get(False, 0)
    found = (sample.mapInArrow(run, "positive boolean, h long").groupBy("h")
             .agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
             .where((F.col("p") >= max(LEAST_DOCS, LEAST_SHARE * n_pos)) & (F.col("p") * max(1, n_unl) > LEAST_LIFT * F.col("u") * max(1, n_pos)))
             .orderBy(F.desc("p"), "h").limit(CANDIDATES).toPandas())
    return np.sort(found.h.to_numpy(np.int64).view(np.uint64))


def corpus_frequency(docs: DataFrame, lookup: Lookup, text: str = "text") -> np.ndarray:
    """In how many rows of the whole corpus each known feature occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(lookup.sorted), np.int64)
        for batch in batches:
            texts = strings(batch.column(0))
            for a, b in batches_of(texts):
                n += np.bincount(lookup.pairs(texts[a:b])[1], minlength=len(n))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there])], names=["place", "n"])

    out = np.zeros(len(lookup.sorted), np.int64)
    for r in docs.select(text).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most CANDIDATES rows
        out[r.place] = r.n
    return out


def _matrix(sample: DataFrame, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Presence of the known features in the sample's rows, and which rows are confirmed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in batches_of(texts):
                row, place = lookup.pairs(texts[a:b])
                x = np.zeros((b - a, len(lookup.sorted)), np.uint8)
                x[row, place] = 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], names=["positive", "x"])

    got = sample.mapInArrow(run, "positive boolean, x binary").toPandas().sort_values(["positive", "x"])
    bits = np.unpackbits(np.stack([np.frombuffer(r, np.uint8) for r in got.x]), axis=1)[:, :len(lookup.sorted)]
    return bits.astype(np.float32), got.positive.to_numpy(bool)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on the text of all ``docs`` and the confirmed rows among them; the caller has limited ``labels`` to its fold.

    Labels of rows that ``docs`` does not hold say nothing: neither the examples nor the prior come from them.
    """
    prepared(docs.sparkSession)
    labels = materialize(labels_of(docs, labels, key, label))
    nothing = ToxicityModel(Lookup(np.zeros(0, np.uint64)), np.zeros((0, 1)))
    share = labels.agg(F.avg("label")).first()[0]
    if not share:
        return nothing
    sample = _sample(docs, labels, key, text)
    hashes = _candidates(sample)
    wide = Lookup(hashes)
    total, n = docs.count(), corpus_frequency(docs, wide, text)
    x, confirmed = _matrix(sample, wide)
    if not confirmed.any() or confirmed.all():
        return nothing
    prior = float(np.clip(PRIOR_MARGIN * share, 0.005, 0.5))
    seen = x[confirmed].sum(0)
    # the share of toxic rows among all rows with the feature, from below: it is also the feature's scale
    purity = np.clip(prior * (seen - np.sqrt(seen)) / confirmed.sum() * (total + 1) / (n + 1), 0, 1)
    kept = np.sort(np.argsort(-purity * np.sqrt(seen), kind="stable")[:FEATURES])
    scale = purity[kept].astype(np.float32)
    weights = [non_negative_pu(x[:, kept] * scale, confirmed, prior, seed=s) for s in range(CLASSIFIERS)]
    return ToxicityModel(Lookup(wide.sorted[kept]), np.array([[*(w[:-1] * scale), w[-1]] for w in weights]))


def score(df: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
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
