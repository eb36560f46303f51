"""Session helpers: recommended settings and lineage cuts that survive executor loss."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators are written for (all are session-level)."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; make one only in a session that runs in one process (as in tests).

    On a cluster every executor has its own disk, so a folder that all of them share must be named.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of this run under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the files that a query has shuffled are removed when the query ends, and not when the driver collects its garbage."""
    before = spark.conf.get(_BRIEF, "false")
    spark.conf.set(_BRIEF, "true")
    try:
        yield
    finally:
        spark.conf.set(_BRIEF, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and continue from the written copy.

    Used where a result feeds several branches and recomputing it would mean reading payloads again.
    A reliable checkpoint (not a local one): losing an executor does not lose the data.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
