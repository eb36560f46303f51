"""How five filters interact: every order of them audited from one count per subset of filters.

A document is turned into a 32-bit word whose bit S is set when the document survives the filters of subset S (bit i of S stands for the
i-th letter of ``FILTERS``). Carry-save adders count each bit position over many words at once: three words of one weight become a sum word
of that weight and a carry word of twice the weight, so that a batch shrinks by a third a pass and only a few words a weight are unpacked.
Those counts, per part and label, answer every order, lost label and Shapley sum; no document is looked at again.

At scale: texts are read once and leave the task as a mask and a digest. Equal texts of one part and label share a word, and n copies enter
the adders at the set bits of n. What is shuffled is slim and pre-aggregated: a text that holds a third of the rows is one row per part and
label. Row ids that are null are dealt out at random instead of meeting in one task.

Edge cases: a null text is empty (A fails, B to E do not, unless it repeats); a null part is the empty string; a null id is neither smaller
nor larger than another, so such a row neither fails E nor makes others fail; rows repeated under one id fail E only if a smaller id holds
the text; several labels of one id count as 1 where any is 1; ids without a label count as neither; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import hidden, materialize, prepared, strings, text_or_empty

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
FEWEST_WORDS, UPPER_PERCENT, DISTINCT_PERCENT = 200, 2, 50
UPPER, SIGNS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"
#: Parts and labels whose planes a task holds before it hands their counts on.
HELD_KEYS = 4096

_SUBSET_IDS = np.arange(SUBSETS)
#: Word of each failure mask: bit S is set when no filter of S fails.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)], np.uint32)


def failures(text: str) -> int:
    """Mask of the failed filters A to D (bits 0 to 3) of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits bytes at \x20 and \x09-\x0D, as asked
    few = len(words) < FEWEST_WORDS
    repeated = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    shouting = 100 * (len(raw) - len(raw.translate(None, UPPER))) > UPPER_PERCENT * len(text)
    signs = len(raw.translate(None, SIGNS)) < len(raw)
    return few | repeated << 1 | shouting << 2 | signs << 3


class PositionalCount:
    """Counts of every bit position over weighted 32-bit words, kept as carry-save planes (plane j holds words of weight 2**j)."""

    def __init__(self) -> None:
        self.planes: list[np.ndarray] = []

    def add(self, words: np.ndarray, copies: np.ndarray) -> None:
        """Words with the number of times each counts."""
        for j in range(int(copies.max(initial=0)).bit_length()):
            self._put(j, words[(copies >> j & 1).astype(bool)])

    def _put(self, j: int, words: np.ndarray) -> None:
        while len(self.planes) <= j:
            self.planes.append(np.empty(0, np.uint32))
        words = np.concatenate([self.planes[j], words])
        while len(words) > 2:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third:2 * third], words[2 * third:3 * third], words[3 * third:]
            either = a ^ b
            words = np.concatenate([either ^ c, rest])
            self._put(j + 1, a & b | either & c)
        self.planes[j] = words

    def counts(self) -> np.ndarray:
        return sum(((int(w) >> _SUBSET_IDS & 1) << j for j, plane in enumerate(self.planes) for w in plane), np.zeros(SUBSETS, np.int64))


def _marked(df: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """One slim row a document: id, part, failure mask of A to D, digest of the text."""
    picked = df.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([failures(t) for t in texts], pa.int32()),
                 pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())],
                names=["id", "part", "fails", "digest"])

    return picked.mapInArrow(run, f"id {id_type}, part string, fails int, digest binary")


def _labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``good`` and ``toxic`` of every row; rows without an id are spread instead of sharing the null key."""
    known = (labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
             .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
                  F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")).withColumn("spread", F.lit(0).cast("long")))
    spread = F.when(F.col("id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    out = rows.withColumn("spread", spread.cast("long")).join(known, ["id", "spread"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """``part, good, toxic, fails`` (mask of A to E) and ``copies``: how many documents are alike in all of these and, but for E, in text."""
    prepared(docs.sparkSession)
    alike = ["digest", "part", "fails", "good", "toxic"]
    by_id = _labelled(_marked(docs, key, part, text), labels, key).groupBy("id", "spread", *alike).agg(F.count("*").alias("n"))
    groups = materialize(by_id.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("at_low"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free")))
    first = groups.groupBy("digest").agg(F.min("low").alias("first"))
    kept = F.col("free") + F.when(F.col("low") == F.col("first"), F.col("at_low")).otherwise(0)
    both = F.array(F.struct(F.col("fails"), kept.alias("copies")),
                   F.struct(F.col("fails").bitwiseOR(F.lit(1 << 4)).alias("fails"), (F.col("n") - kept).alias("copies")))
    return groups.join(first, "digest").select("part", "good", "toxic", F.inline(both)).where("copies > 0")


def survivors(rows: DataFrame) -> DataFrame:
    """Per ``part``: arrays over all subsets of ``kept``, ``good`` and ``toxic`` documents that survive the subset's filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, PositionalCount] = {}

        def handed_on() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()),
                 pa.array([held[k].counts().tolist() for k in keys], pa.list_(pa.int64()))], names=["part", "good", "toxic", "alive"])

        for batch in batches:
            words = WORDS[batch.column(3).to_numpy(zero_copy_only=False)]
            copies = batch.column(4).to_numpy(zero_copy_only=False)
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                places.setdefault(k, []).append(i)
            for k, at in places.items():
                held.setdefault(k, PositionalCount()).add(words[at], copies[at])
            if len(held) > HELD_KEYS:
                yield handed_on()
                held.clear()
        if held:
            yield handed_on()

    counted = rows.select("part", "good", "toxic", "fails", "copies").mapInArrow(run, "part string, good int, toxic int, alive array<bigint>")
    by_subset = counted.select("part", "good", "toxic", F.posexplode("alive").alias("subset", "n")).groupBy("part", "subset").agg(
        F.sum("n").alias("kept"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    # thirty-two entries a part
    listed = by_subset.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("s"))
    return listed.select("part", *[F.col(f"s.{c}").alias(c) for c in ("kept", "good", "toxic")])


def _steps() -> list[dict]:
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "f": f, "own": 1 << f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    return out


def _shapley(f: int) -> Column:
    """Removed by filter ``f`` at its step, summed over all orders."""
    n, terms = len(FILTERS), []
    for s in range(SUBSETS):
        if not s >> f & 1:
            weight = math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
            terms.append(weight * (F.col("kept")[s] - F.col("kept")[s | 1 << f]))
    return sum(terms[1:], terms[0])


def interactions(alive: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the arrays of :func:`survivors`."""
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order string, step int, f int, own int, before int, after int>>")
    shapley = hidden("shapley")
    rows = alive.withColumn(shapley, F.array(*[_shapley(f) for f in range(len(FILTERS))])).select("*", F.inline(steps))
    removed = F.col("kept")[F.col("before")] - F.col("kept")[F.col("after")]
    own = F.col("own")
    return rows.select(
        "part", "filter_order", "step", F.col("kept")[F.col("after")].alias("kept"), removed.alias("removed"),
        (F.col("kept")[0] - F.col("kept")[own] - removed).alias("redundant"),
        (F.col("kept")[F.lit(SUBSETS - 1) - own] - F.col("kept")[SUBSETS - 1]).alias("unique_fails"),
        (F.col("good")[F.col("before")] - F.col("good")[F.col("after")]).alias("good_lost"),
        (F.col("toxic")[F.col("before")] - F.col("toxic")[F.col("after")]).alias("toxic_lost"), F.col(shapley)[F.col("f")].alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """The interaction table of the five filters over ``docs``."""
    return interactions(survivors(masks(docs, labels, key, part, text)))
