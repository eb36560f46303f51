"""Stream configuration: rules, derived attributes and word maps, as DataFrames over all streams at once."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lockstep.functions.text import parse_hex, receiver_prefix

# Limits and defaults a configuration is held to.
WORD_LEN = 16
FULL_SCALE = 65535
MIN_FRAME_BITS, MAX_FRAME_BITS = 64, 65536
MAX_SYNC_DIGITS = 16
MAX_RATE_MBPS = 1000.0
MIN_SCALE, MAX_SCALE = 0.001, 999.999
MAX_RECEIVERS = MAX_CHANNELS = 100
PERIOD_TICKS = {0: 10_000_000, 1: 1_000_000, 2: 100_000}
VOLT_LOW = [-10.0, -5.0, 0.0, 0.0]
VOLT_HIGH = [10.0, 5.0, 10.0, 5.0]
SETTING_SECTIONS = ["Defaults", "Frame", "Parameters", "Time", "Receivers", "Bounds", "EMPTY"]


def full_mask(bits: Column) -> Column:
    """``bits`` ones as a signed long holding an unsigned value."""
    return F.when(bits >= 64, F.lit(-1).cast("long")).otherwise(F.pow(F.lit(2.0), bits).cast("long") - 1)


def resolve_sync(df: DataFrame, pattern: str = "sync_hex", mask: str = "mask_hex") -> DataFrame:
    """Hex text to ``pattern``, ``mask``, ``sync_len`` and ``sync_error`` (the pattern's error comes first).

    The length is four bits for every character as written, spaces included; an empty mask is all ones of that length.
    """
    text, cover = F.coalesce(F.col(pattern), F.lit("")), F.coalesce(F.col(mask), F.lit(""))
    value, given = parse_hex(text), parse_hex(cover)
    error = (F.when(text == "", "pattern_empty").when(value.isNull(), "pattern_invalid")
             .when((cover != "") & given.isNull(), "mask_invalid"))
    length = F.length(text) * 4
    staged = df.withColumns({"sync_error": error, "sync_len": length, "pattern": value,
                             "mask": F.when(cover == "", full_mask(length)).otherwise(given)})
    bad = F.col("sync_error").isNotNull()
    return staged.withColumns({c: F.when(~bad, F.col(c)) for c in ("sync_len", "pattern", "mask")})


def validate_streams(streams: DataFrame) -> DataFrame:
    """One row per broken rule (``stream_id, rule_no, rule``), in the order a form would show them."""
    pattern, mask = F.trim(F.coalesce("sync_hex", F.lit(""))), F.trim(F.coalesce("mask_hex", F.lit("")))
    hexes = f"^[0-9A-Fa-f]{{1,{MAX_SYNC_DIGITS}}}$"
    receiver = F.col("mode") == "receiver"
    rate, scale = F.col("data_rate_mbps"), F.col("scale_db_per_v")
    rules = [
        ("pattern_required", pattern == ""),
        ("pattern_not_hex", (pattern != "") & ~pattern.rlike(hexes)),
        ("mask_not_hex", (mask != "") & ~mask.rlike(hexes)),
        ("bits_in_frame", ~F.col("bits_in_frame").between(MIN_FRAME_BITS, MAX_FRAME_BITS)),
        ("data_rate", F.isnan(rate) | ~rate.between(0.0, MAX_RATE_MBPS)),
        ("period", ~F.col("period_idx").between(0, 2)),
        ("polarity", receiver & ~F.col("polarity").between(0, 1)),
        ("slope", receiver & ~F.col("slope_idx").between(0, 3)),
        ("scale", receiver & (F.isnan(scale) | ~scale.between(MIN_SCALE, MAX_SCALE))),
        ("receivers", receiver & ~F.col("num_receivers").between(1, MAX_RECEIVERS)),
        ("channels", receiver & ~F.col("receiver_channels").between(1, MAX_CHANNELS)),
    ]
    broken = F.array(*[F.when(test, F.struct(F.lit(i).alias("rule_no"), F.lit(name).alias("rule")))
                       for i, (name, test) in enumerate(rules)])
    return (streams.select("stream_id", F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("r"))
            .select("stream_id", "r.rule_no", "r.rule"))


def resolve_attributes(streams: DataFrame) -> DataFrame:
    """What the search runs with: bit period from the configured rate, else the catalog's; at least one sync; 16-bit words."""
    def have(name: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(name), otherwise) if name in streams.columns else otherwise

    rate = F.coalesce(F.col("data_rate_mbps"), F.lit(0.0)) * 1.0e6
    rate = F.when(rate > 0, rate).otherwise(0.0)
    known = have("bit_rate_bps", F.lit(0.0))
    return streams.withColumns({
        "rate_bps": rate,
        "bit_ticks": F.when(rate > 0, 1.0e7 / rate).when(known > 0, 1.0e7 / known).otherwise(0.0),
        "min_syncs": F.greatest(F.lit(1), have("min_syncs", F.lit(1))).cast("int"),
        "word_len": have("word_len", F.lit(WORD_LEN)).cast("int"),
        "words_in_frame": words_in_frame(F.col("bits_in_frame")),
        "swap_bytes": have("swap_bytes", F.lit(True)),
        "inverted": have("inverted", F.lit(False)),
        "randomized": have("randomized", F.lit(False)),
        "use_rate_clock": have("use_rate_clock", F.lit(False)),
        "period_ticks": have("period_ticks", F.lit(PERIOD_TICKS[0])).cast("long"),
    })


def prepare_streams(streams: DataFrame) -> DataFrame:
    """``resolve_sync`` and ``resolve_attributes`` for streams whose sync text is valid."""
    return resolve_attributes(resolve_sync(streams).where(F.col("sync_error").isNull()))


def words_in_frame(bits: Column) -> Column:
    return F.ceil(bits / WORD_LEN).cast("int")


# --- word maps ----------------------------------------------------------------------------------------------------------

def read_word_map(spark: SparkSession, path: str, map_id: str) -> DataFrame:
    """A word-map file's sections in order: ``map_id, ord, section, word`` (1-based as written, null if missing).

    A small configuration file, read on the driver.
    """
    with open(path, encoding="utf-8-sig") as handle:
        sections = tomllib.loads(_unique_empty(handle.read()))
    rows = [(map_id, i, "EMPTY" if name.startswith("EMPTY") else name, body.get("Word") if isinstance(body, dict) else None)
            for i, (name, body) in enumerate(sections.items()) if isinstance(body, dict)]
    return spark.createDataFrame(rows, "map_id string, ord int, section string, word int")


def _unique_empty(text: str) -> str:
    """Repeated ``[EMPTY]`` placeholders, which strict TOML refuses, get distinct names."""
    out = []
    for i, line in enumerate(text.splitlines()):
        out.append(f"[EMPTY{i}]" if line.strip().strip("[]\"' ").upper() == "EMPTY" and line.strip().startswith("[") else line)
    return "\n".join(out)


def resolve_word_map(streams: DataFrame, maps: DataFrame) -> DataFrame:
    """Every stream's parameters: its named map, else the default map, else receivers times channels in sequence.

    ``maps`` holds map sections (``map_id, ord, section, word``) and ``streams`` names them (``explicit_map``, ``default_map``,
    ``words_in_frame``, ``num_receivers``, ``receiver_channels``). A map is refused if any parameter lacks a word or has one
    outside 1 .. words_in_frame - 1: for a named map that is an error, for the default one it falls through to the sequence.
    Returns ``stream_id, source, error, warning, ord, name, word`` (zero-based word; one row with nulls on error).
    """
    params = maps.where(~F.col("section").isin(SETTING_SECTIONS))
    known = maps.select("map_id").distinct()
    wanted = streams.select("stream_id", "words_in_frame", F.explode(F.array(
        F.struct(F.lit("explicit").alias("source"), F.col("explicit_map").alias("map_id")),
        F.struct(F.lit("default").alias("source"), F.col("default_map").alias("map_id")))).alias("w")).select(
        "stream_id", "words_in_frame", "w.*").where("map_id is not null and map_id <> ''")
    bad = F.count_if(F.col("section").isNotNull() & (F.col("word").isNull() | (F.col("word") < 1)
                                                     | (F.col("word") > F.col("words_in_frame") - 1)))
    listed = F.collect_list(F.when(F.col("section").isNotNull(), F.struct("ord", F.col("section").alias("name"),
                                                                          (F.col("word") - 1).alias("word"))))
    tried = (wanted.join(known.withColumn("_found", F.lit(True)), "map_id", "left").join(params, "map_id", "left")
             .groupBy("stream_id", "source").agg(F.coalesce(F.first("_found", True), F.lit(False)).alias("found"),
                                                 bad.alias("bad"), F.array_sort(listed).alias("params")))
    explicit = tried.where("source = 'explicit'").select("stream_id", F.struct("found", "bad", "params").alias("x"))
    default = tried.where("source = 'default'").select("stream_id", F.struct("found", "bad", "params").alias("d"))
    both = streams.join(explicit, "stream_id", "left").join(default, "stream_id", "left")
    sequence = F.transform(F.sequence(F.lit(0), F.col("num_receivers") * F.col("receiver_channels") - 1), lambda i: F.struct(
        i.alias("ord"), F.concat(receiver_prefix(i % F.col("receiver_channels")), F.lit("_RCVR"),
                                 (F.floor(i / F.col("receiver_channels")) + 1).cast("string")).alias("name"),
        i.cast("int").alias("word")))
    fits = ((F.col("num_receivers") > 0) & (F.col("receiver_channels") > 0)
            & (F.col("num_receivers") * F.col("receiver_channels") < F.col("words_in_frame")))
    named = F.col("x").isNotNull()
    use_default = ~named & F.coalesce(F.col("d.found") & (F.col("d.bad") == 0), F.lit(False))
    source = F.when(named, "explicit").when(use_default, "default").otherwise("sequence")
    chosen = F.when(named, F.col("x.params")).when(use_default, F.col("d.params")).when(fits, sequence)
    error = (F.when(named & ~F.col("x.found"), "not_found").when(named & (F.col("x.bad") > 0), "bad_map")
             .when(~named & ~use_default & ~fits, "grid_too_large")
             .when((named | use_default) & (F.size(chosen) == 0), "no_parameters"))
    warning = F.when(~named & F.coalesce(F.col("d.found") & (F.col("d.bad") > 0), F.lit(False)), "default_refused")
    rows = both.select("stream_id", source.alias("source"), error.alias("error"), warning.alias("warning"), chosen.alias("p"))
    kept = rows.withColumn("p", F.when(F.col("error").isNull(), F.col("p")))
    return kept.select("stream_id", "source", "error", "warning", F.explode_outer("p").alias("p")).select(
        "stream_id", "source", "error", "warning", F.col("p.ord").cast("int").alias("ord"), "p.name", F.col("p.word").cast("int").alias("word"))


def word_map_order(word_map: DataFrame) -> DataFrame:
    """Word map with ``ord`` made dense from 0 in listed order."""
    return word_map.withColumn("ord", F.row_number().over(W.partitionBy("stream_id").orderBy("ord")) - 1)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """A step file: every ``[[Step]]`` in order, a missing or unusable ``db`` reading 0."""
    with open(path, "rb") as handle:
        steps = tomllib.load(handle).get("Step", [])
    rows = [(i, float(s["db"]) if isinstance(s.get("db"), (int, float)) else 0.0) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step_idx int, db double")
