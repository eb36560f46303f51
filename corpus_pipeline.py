"""Training-corpus pipeline over ``documents``: each stage reads what the one before wrote.

Stages 1 to 4 return the columns they were given (``doc_id, text, lang, source, n_chars`` and any others); the last returns the pieces of
documents and their places in training sequences. Null and empty texts pass every filter that does not reject them by score; an empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm import entries, near_dup, passages, quality, toxicity
from lockstep.llm.common import hidden, materialize, table

#: Bytes of a passage that goes where it repeats: less than fifty words have, so that a repeated passage of more than fifty is covered whole.
PASSAGE_BYTES = 240


def _filtered(docs: DataFrame, operator, sf_dir: str, keeps) -> DataFrame:
    """The rows whose score ``keeps``; the model learns from the training fold of these rows and of ``labels``."""
    model = entries.learned(docs, table(docs.sparkSession, sf_dir, "labels"), operator)
    score = hidden("score")
    return operator.score(docs, model, tuple(docs.columns), name=score).where(keeps(F.col(score))).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, quality, sf_dir, lambda score: score >= entries.GOOD_FROM)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, toxicity, sf_dir, lambda score: score < entries.TOXIC_FROM)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``PASSAGE_BYTES`` and more that repeat; bytes of a character that was cut through go with the passage. ``n_chars`` is counted anew."""
    rest = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    left = passages.cut(docs.select(*rest, "text"), rest, length=PASSAGE_BYTES)
    out = left.withColumn("text", F.col("kept_text"))
    return (out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return entries.packed(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_copies", no_near_copies), ("passages", no_repeated_passages), ("packing", packed)]

#: Trained classifiers and signatures are beyond SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in their order."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
