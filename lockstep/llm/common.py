"""Helpers shared by the text operators: reading, folds, bounded batches, names that cannot clash."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lockstep.session import configure, materialize

__all__ = ["batches_of", "fold", "hidden", "labels_of", "prepared", "strings", "table", "text_or_empty", "materialize", "with_fields"]

#: Rows per Arrow batch: texts may be long, so a batch must stay small whatever its rows hold.
BATCH_ROWS = 500
#: Characters handled by one numpy pass.
BATCH_CHARS = 1_000_000


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's options and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hidden(stem: str) -> str:
    """A column name that no caller's column has."""
    return f"__{stem}_{uuid.uuid4().hex[:8]}"


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; -1 where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts, F.lit(-1))


def labels_of(docs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``key, label`` (0 or 1) of the labelled rows whose key is a row of ``docs``; ids alone are shuffled."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    return known.join(docs.select(F.col(key).alias("key")), "key", "left_semi")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batches_of(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about ``limit`` characters together; one longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` followed by the fields of ``ddl``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]
