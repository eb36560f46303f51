"""Durable results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_per_source(df: DataFrame, path: str, source: str = "source_id", order: str = "t_abs") -> None:
    """One folder per recording. Rows are dealt by ranges of (source, order), so a recording has writers in proportion to its rows."""
    df.repartitionByRange(source, order).write.mode("overwrite").partitionBy(source).parquet(path)


def write_samples(points: DataFrame, path: str, series: list[str] | None = None, x: str = "elapsed") -> None:
    """Long results by (source, metric) folder, sorted by series and time, so time ranges prune row groups."""
    series = series or ["stream_seq", "name"]
    (points.repartitionByRange("source_id", "metric", *series, x).sortWithinPartitions("source_id", "metric", *series, x)
     .write.mode("overwrite").partitionBy("source_id", "metric").parquet(path))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
