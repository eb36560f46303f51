"""Language of whole texts by error-correcting output codes over character n-grams.

Every language gets a codeword; one logistic classifier per bit, on hashed frequencies of letter 1- to 3-grams, learns that bit. A text
goes to the language whose codeword costs least, bits weighted by how well they were learned; a text whose two cheapest languages cost
nearly the same is flagged as ambiguous. Every language of the table is learned, however rare, from at most ``per_language`` of its rows
with a letter, drawn by hash of id and text; codewords grow with the logarithm of the number of languages.

Edge cases: a null text or one without a letter is ``und`` with score 0; with no labelled row every text is ``und``; with one language
every text with a letter is that language, score 1. A null id is never held out nor learned from. Repeated rows give repeated rows; an
empty table gives none; other columns do not pass and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.chars import TABLED, code_points, tables
from lockstep.llm.common import batches_of, prepared, strings, with_fields

#: Hash buckets of n-grams.
BUCKETS = 2048
#: Most rows of each language that are learned from; with so many languages that this makes more than MOST_ROWS, each has fewer (one at least).
PER_LANGUAGE, MOST_ROWS = 800, 40_000
#: Gap of normalised costs below which a text is ambiguous.
AMBIGUOUS_GAP = 0.05
UNDETERMINED = "und"


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of hashed n-gram frequencies (rows of length 1), and whether a text has a letter."""
    _, letter, lower, _ = tables()
    points, starts = code_points([t.lower() for t in texts], " ")
    low = np.minimum(points, TABLED - 1)
    is_letter = letter[low] | (points >= TABLED)
    c = np.where(is_letter, np.where(points < TABLED, lower[low], points), 32).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]  # runs of other characters become one space
    keep[starts[1:-1]] = True
    text = np.searchsorted(starts, np.flatnonzero(keep), side="right") - 1
    c = c[keep]
    out = np.zeros((len(texts), BUCKETS))
    rolled, same = np.zeros(len(c), np.uint64), np.ones(len(c), bool)
    for n in range(3):
        rolled[: len(c) - n] = rolled[: len(c) - n] * np.uint64(0x9E3779B97F4A7C15) + c[n:] + np.uint64(1)
        same[: len(c) - n] &= text[: len(c) - n] == text[n:]
        same[max(0, len(c) - n):] = False
        key = rolled ^ (rolled >> np.uint64(31))
        bucket = ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 11)).astype(np.int64)
        use = same if n else same & (c != 32)
        out += np.bincount(text[use] * BUCKETS + bucket[use], minlength=out.size).reshape(out.shape)
    any_letter = np.add.reduceat(is_letter, starts[:-1], dtype=np.int64) > 0 if texts else np.zeros(0, bool)
    out = np.sqrt(out)
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32), any_letter


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """+1/-1 codewords: all splits where these are few, else random ones, the draw with the largest least distance."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 5:
        splits = np.arange(1, 2 ** (languages - 1))
        return 2.0 * ((splits[None, :] >> np.arange(languages)[:, None]) & 1) - 1
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, gap = None, -1
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        near = (code @ code.T - 2 * bits * np.eye(languages)).max()
        if bits - near > gap and (np.abs(code.sum(0)) < languages).all():
            best, gap = code, bits - near
    return best


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS + 1 by bits
    trust: np.ndarray    # weight of each bit's loss

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Weighted log losses of all codewords: a bit costs one of two amounts, so two products with the code give every sum."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        plus, minus = np.logaddexp(0, -margin) * self.trust, np.logaddexp(0, margin) * self.trust
        return plus @ (self.code > 0).T + minus @ (self.code < 0).T

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (softmax of the negative costs) and ambiguity of each text."""
        if not texts or not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        x, known = features(texts)
        if len(self.languages) == 1:
            return [self.languages[0] if k else UNDETERMINED for k in known], known.astype(float), ~known
        cost = self.costs(x)
        share = np.exp(-(cost - cost.min(1, keepdims=True)) * self.code.shape[1])
        share /= share.sum(1, keepdims=True)
        best = cost.argmin(1)
        two = np.partition(cost, 1, axis=1)
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        return names, np.where(known, share.max(1), 0.0), (two[:, 1] - two[:, 0] < AMBIGUOUS_GAP) | ~known


def fit(x: np.ndarray, languages: list[str], seed: int = 1) -> CodeModel:
    """One logistic classifier per bit, all trained together (Adam on minibatches; languages weigh alike)."""
    names = sorted(set(languages))
    code = codewords(len(names))
    if len(names) < 2:
        return CodeModel(names, code, np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    place = {n: i for i, n in enumerate(names)}
    label = np.array([place[v] for v in languages])
    size = np.bincount(label)
    share = 1 / size[label]
    chance = share / share.sum()
    rng = np.random.default_rng(seed)
    w = np.zeros((BUCKETS + 1, code.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    ones = np.ones((256, 1), np.float32)
    for step in range(1, max(300, 2 * len(names)) + 1):
        pick = rng.choice(len(label), 256, p=chance)
        xb, yb = np.hstack([x[pick], ones]), code[label[pick]]
        slope = -yb / (1 + np.exp(yb * (xb @ w)))
        g = xb.T @ slope / 256 + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    hit = (x @ w[:-1] + w[-1]) * code[label] > 0
    right = (np.add.reduceat(hit[np.argsort(label, kind="stable")], np.cumsum(size) - size, axis=0, dtype=np.float64) / size[:, None]).mean(0)
    trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    return CodeModel(names, code, w, trust / trust.sum())


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> CodeModel:
    """Fit on at most ``per_language`` rows of each language; the rows are featurised where they lie."""
    prepared(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(17)).alias("h"), F.xxhash64(text).alias("h2"))
    # One row per language, as the model holds too. A local table has a known size: Spark sends it to the rows, and texts are not shuffled.
    counts = rows.groupBy("lang").count().toArrow()
    languages = counts.num_rows
    if not languages:
        return CodeModel([], np.ones((0, 0)), np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    quota = max(1, min(per_language, MOST_ROWS // languages))
    # thinned first, with room for chance, so that no language is brought together; then the exact first rows of each
    share = F.lit(2.0 * quota + 40) / F.col("count")
    thin = rows.join(labelled.sparkSession.createDataFrame(counts), "lang").where(F.pmod(F.xxhash64("h", "h2"), F.lit(1_000_000)) < share * 1_000_000)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "h2", "text"))
    picked = thin.withColumn("_place", place).where(F.col("_place") <= quota).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(0))
            for a, b in batches_of(texts):
                x, known = features(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a).filter(pa.array(known)), pa.array([r.astype("<f2").tobytes() for r in x[known]], pa.binary())],
                    names=["lang", "x"])

    got = picked.mapInArrow(run, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    x = np.stack([np.frombuffer(r, "<f2") for r in got.x]).astype(np.float32) if len(got) else np.zeros((0, BUCKETS), np.float32)
    return fit(x, got.lang.tolist())


def predict(df: DataFrame, model: CodeModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``ambiguous``."""
    prepared(df.sparkSession)
    schema = with_fields(df.select(*keep), "lang_pred string, score double, ambiguous boolean")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(n))
            for a, b in batches_of(texts):
                names, score, unsure = model.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:n]), pa.array(names, pa.string()),
                                                  pa.array(score), pa.array(unsure)], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)
