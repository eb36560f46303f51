"""Series as CSV: one time column on the millisecond grid, one column per series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.functions import text
from lockstep.functions.text import LEVEL, TIME_HEADER, trimmed
from lockstep.operators.scans import Carry, ordered_scan, per_stream
from lockstep.operators.series import channel_index
from lockstep.session import materialize

BYTE_ORDER_MARK = "\ufeff"


def csv_cells(points: DataFrame, series: str = "series_no", x: str = "elapsed", sample: str = "sample_no", value: str = "value") -> DataFrame:
    """Samples on the millisecond grid, halves away from zero; of a series' samples in one millisecond the last wins."""
    placed = points.select(F.col(series).alias("series_no"), text.round_millis(F.col(x)).alias("ms"), F.col(sample).alias("_n"), F.col(value).alias("value"))
    return placed.groupBy("ms", "series_no").agg(F.max_by("value", "_n").alias("value"))


def csv_rows(points: DataFrame, n_series: int, day: Column, offset: Column, **columns: str) -> DataFrame:
    """``ms, line``: the stamp and one cell per series (empty where a series has no sample). One shuffle by millisecond."""
    cells = csv_cells(points, **columns).withColumn("cell", text.format_fixed6("value"))
    rows = cells.groupBy("ms").agg(F.map_from_entries(F.collect_list(F.struct(F.col("series_no").cast("int"), "cell"))).alias("m"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_series - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), ",")
    return rows.select("ms", F.concat_ws(",", text.clock_stamp(day, offset, F.col("ms") / 1000.0), body).alias("line"))


def csv_header(series: DataFrame) -> str:
    """The header line for a series table (``series_no, metric, name, source_id``): a few names, gathered on the driver."""
    names = series.select("series_no", text.column_header(F.col("metric"), F.col("name"), F.col("source_id")).alias("h")).orderBy("series_no")
    return ",".join([TIME_HEADER, *[r.h for r in names.collect()]])


def write_series_csv(points: DataFrame, series: DataFrame, day: int, offset: float, path: str, encoding: str = "UTF-8") -> None:
    """Write the export as a folder of CSV parts in time order (CRLF line ends, the header in a part of its own that sorts first).

    Rows are range-partitioned and sorted by millisecond, so concatenating the parts in name order gives the single-file export.
    ``encoding`` may be UTF-16LE or UTF-16BE; the header then starts with a byte-order mark.
    """
    header = csv_header(series)
    n = series.count()
    rows = csv_rows(points, n, F.lit(day), F.lit(offset)).repartitionByRange("ms").sortWithinPartitions("ms")
    spark = points.sparkSession

    def write(lines: DataFrame, mark: str, part: str) -> None:
        text_ = F.concat(F.lit(mark), "line")
        raw = text_ if encoding == "UTF-8" else F.encode(text_, encoding).cast("string")  # the writer puts bytes out as they are
        lines.select(raw.alias("value")).write.option("lineSep", "\r\n").option("encoding", encoding).mode("overwrite").text(f"{path}/{part}")

    write(spark.createDataFrame([(header,)], "line string").coalesce(1), "" if encoding == "UTF-8" else BYTE_ORDER_MARK, "part=0")
    write(rows, "", "part=1")


def _pieces(spark: SparkSession, path: str, one_export: bool, encoding: str = "UTF-8") -> DataFrame:
    """``file, line_at, raw``: the bytes between line feeds of ``encoding``, with an order column that follows the file, whatever its splits."""
    raw = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    name = F.col("_metadata.file_path")
    spot = F.struct((name if one_export else F.lit("")).alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return raw.select((F.lit(path) if one_export else name).alias("file"), spot.alias("line_at"), F.col("value").cast("binary").alias("raw"))


def _whole_lines(pieces: DataFrame, encoding: str) -> DataFrame:
    """Join again what was cut inside a character: in UTF-16 the bytes of a line feed may be halves of two characters.

    A cut is a line's end only at an even number of bytes, counted from the file's start. A file with a wrong cut has a piece of odd length;
    only such files are scanned in order.
    """
    odd = F.length("raw") % 2 == 1
    torn = materialize(pieces.where(odd).select("file").distinct())
    rest = pieces.join(per_stream(torn), "file", "left_anti")
    cut = pieces.join(per_stream(torn), "file", "left_semi").withColumn("_odd", odd.cast("long"))
    chunk = F.struct("line_at.part", "line_at.block")
    placed = ordered_scan(cut, ["file"], ["line_at"], [Carry("_before", F.col("_odd"), "sum", inclusive=False)], chunk)
    starts = placed.withColumn("_start", F.when(F.col("_before") % 2 == 0, F.col("line_at")))
    owned = ordered_scan(starts, ["file"], ["line_at"], [Carry("_of", F.col("_start"), "last")], chunk)
    feed = F.lit(bytearray("\n".encode(encoding)))
    parts = owned.groupBy("file", "_of").agg(F.array_sort(F.collect_list(F.struct("line_at", "raw"))).alias("p"))  # a line's few pieces
    joined = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.col("p")[0].raw, lambda line, p: F.concat(line, feed, p.raw))
    return rest.unionByName(parts.select("file", F.col("_of").alias("line_at"), joined.alias("raw")))


def _decoded(encoding: str):
    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        # half a pair reads as the replacement character, and a last odd byte is no character
        return raw.map(lambda b: bytes(b)[: len(b) // 2 * 2].decode(encoding, "replace"))

    return decode


def read_lines(spark: SparkSession, path: str, one_export: bool = False, encoding: str | None = None) -> DataFrame:
    """``file, line_at, line`` with an order column that follows the file, whatever its splits; carriage returns are ignored.

    With ``one_export`` the files under ``path`` are the parts of one file, in the order of their names. Files are UTF-8, or UTF-16 of either
    byte order if they start with its mark; a folder may hold all three. Looking for marks is one more pass; ``encoding`` saves it where all
    files are known to be alike.
    """
    kinds = None
    if encoding is None:
        heads = _pieces(spark, path, one_export).where("line_at.block = 0").groupBy("file").agg(F.min_by("raw", "line_at").alias("raw"))
        mark = F.hex(F.substring("raw", 1, 2))
        kinds = materialize(heads.select("file", F.when(mark == "FFFE", "UTF-16LE").when(mark == "FEFF", "UTF-16BE").otherwise("UTF-8").alias("encoding")))
        found = sorted(r.encoding for r in kinds.select("encoding").distinct().collect())  # three at most
    out = None
    for name in [encoding] if encoding else found or ["UTF-8"]:
        pieces = _pieces(spark, path, one_export, name)
        if kinds is not None and len(found) > 1:
            pieces = pieces.join(per_stream(kinds.where(F.col("encoding") == name).select("file")), "file", "left_semi")
        line = F.col("raw").cast("string") if name == "UTF-8" else _decoded(name)("raw")
        lines = (pieces if name == "UTF-8" else _whole_lines(pieces, name)).select("file", "line_at", F.translate(line, "\r", "").alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


def read_series_csv(spark: SparkSession, path: str, one_export: bool = False, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every export under ``path``, or the one whose parts lie there: (points, files).

    ``files`` has per file the outcome: ``ok``, ``skipped`` rows, ``base_day``, ``base_offset`` and ``x_max``. Points carry the identity parsed
    from the headers. Rows with too few cells or a bad stamp are skipped and counted; a cell that is no number is skipped alone.

    What is known of a file (its first line, its width, its base, its columns) is sent to every task: joined by a shuffle, all lines of a file
    would meet in one task.
    """
    lines = read_lines(spark, path, one_export, encoding)
    first = lines.groupBy("file").agg(F.min("line_at").alias("line_at"))
    heads = lines.join(per_stream(first), ["file", "line_at"], "left_semi").select("file", F.col("line_at").alias("_head_at"), F.split(
        F.regexp_replace("line", "^﻿", ""), ",", -1).alias("header"))
    good_head = (F.size("header") >= 2) & (trimmed(F.try_element_at("header", F.lit(1))) == TIME_HEADER)
    accepted = heads.where(good_head)
    columns = channel_columns(accepted)
    body = lines.join(per_stream(accepted.select("file", "_head_at", F.size("header").alias("_width"))), "file").where("line_at > _head_at and line <> ''")
    cells = F.split("line", ",", -1)
    rows = body.select("file", "line_at", cells.alias("cells"), text.parse_stamp(F.try_element_at(cells, F.lit(1))).alias("stamp"), "_width")
    good = F.coalesce(F.size("cells") >= F.col("_width"), F.lit(False)) & F.col("stamp").isNotNull()
    counted = rows.groupBy("file").agg(F.count_if(~good).alias("skipped"), F.min_by("stamp", F.when(good, F.col("line_at"))).alias("base"))
    timed = rows.where(good).join(per_stream(counted.select("file", "base")), "file").withColumn(
        "elapsed", (F.col("stamp.day") - F.col("base.day")) * 86400.0 + (F.col("stamp.seconds") - F.col("base.seconds")))
    long = timed.select("file", "line_at", "elapsed", F.posexplode(F.slice("cells", 2, F.col("_width") - 1)).alias("series_no", "cell")).withColumn(
        "value", text.parse_double(F.col("cell"))).where("value is not null").drop("cell")
    ends = long.groupBy("file", "series_no").agg(F.max_by("elapsed", "line_at").alias("_end")).groupBy("file").agg(
        F.greatest(F.lit(0.0), F.max("_end")).alias("x_max"))
    files = (heads.select("file", good_head.alias("_head_ok")).join(counted, "file", "left").join(ends, "file", "left").select(
        "file", (F.col("_head_ok") & F.col("x_max").isNotNull()).alias("ok"), F.coalesce("skipped", F.lit(0)).alias("skipped"),
        F.col("base.day").alias("base_day"), F.col("base.seconds").alias("base_offset"), "x_max"))
    return long.join(per_stream(columns), ["file", "series_no"]), files


def channel_columns(headers: DataFrame) -> DataFrame:
    """Series identities from header rows (``file, header``), level series numbered within (file, source, stream, receiver)."""
    named = headers.select("file", F.posexplode(F.slice("header", 2, F.size("header") - 1)).alias("series_no", "h"))
    parsed = named.select("file", "series_no", text.parse_header(trimmed(F.col("h"))).alias("p")).select("file", "series_no", "p.*")
    levels = channel_index(parsed.where(F.col("metric") == LEVEL), ["file", "source_id", "stream_order", "receiver"], "series_no")
    return parsed.where(F.col("metric") != LEVEL).withColumn("channel", F.lit(0)).unionByName(levels)


def number_samples(points: DataFrame, keys: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """Add ``sample_no`` within each series."""
    return ordered_scan(points, keys, order, [Carry("sample_no", F.lit(1), "count", inclusive=False)], chunk)
