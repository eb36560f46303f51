"""From a recording's packets to streams: catalog, quality gates, routing, absolute time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lockstep.functions.text import parse_double, parse_int, trimmed
from lockstep.operators.lookup import asof_backward
from lockstep.operators.scans import Carry, ordered_scan, per_stream
from lockstep.sources.ch10 import PCM, TIME, TMATS

# Fixed values.
CSDW_BYTES = 4
MAX_PACKET_BYTES = 100 * 1024 * 1024
GAP_TICKS = 20_000_000
TICKS_PER_SECOND = 10_000_000
OFFSETS_PER_CHUNK = 1 << 26
TIME_TYPE, PCM_TYPE = "TIMEIN", "PCMIN"


def offset_chunk(offset: str = "file_offset", size: int = OFFSETS_PER_CHUNK) -> Column:
    """Byte-range chunk of a file: at most ``size`` bytes of packets, whatever their number or channel."""
    return F.expr(f"{offset} div {size}")


# --- TMATS ----------------------------------------------------------------------------------------------------------------

def first_tmats(packets: DataFrame, key: str = "source_id") -> DataFrame:
    first = packets.where(F.col("data_type") == TMATS).groupBy(key).agg(F.min("file_offset").alias("file_offset"))
    return packets.where(F.col("data_type") == TMATS).join(first, [key, "file_offset"], "left_semi")


def explode_attributes(texts: DataFrame, text: str = "text", key: str = "source_id") -> DataFrame:
    """``CODE:VALUE;`` lines as rows (``code, value``); a code given twice keeps its last value."""
    line = F.split(F.regexp_replace(F.col(text), "\r", "\n"), "\n")
    rows = texts.select(key, F.posexplode(line).alias("pos", "line")).withColumn("line", trimmed(F.col("line"))).where(F.contains("line", F.lit(":")))
    parts = rows.select(key, "pos", trimmed(F.substring_index("line", ":", 1)).alias("code"), F.rtrim(trimmed(
        F.expr("substring(line, instr(line, ':') + 1)")), F.lit(";")).alias("value"))
    return parts.groupBy(key, "code").agg(F.max_by("value", "pos").alias("value"))


def tmats_attributes(packets: DataFrame) -> DataFrame:
    """``source_id, code, value`` of each recording's first TMATS packet."""
    text = F.decode(F.expr(f"substring(payload, {CSDW_BYTES + 1})"), "ISO-8859-1")
    return explode_attributes(first_tmats(packets).select("source_id", text.alias("text")))


def channel_catalog(attributes: DataFrame) -> DataFrame:
    """``source_id, channel_id, name, type, enabled, bit_rate_bps`` of every enabled data source with a usable track number.

    A missing enable flag means enabled. Names prefer the data source id, then the two link names. The rate comes from the PCM
    record whose link name the source carries. If two sources share a track the later one names it.
    """
    code = F.upper("code")
    field = attributes.select(
        "source_id", F.regexp_extract(code, r"^R-(\d+)\\([A-Z0-9]+)-(\d+)$", 1).alias("r"),
        F.regexp_extract(code, r"^R-(\d+)\\([A-Z0-9]+)-(\d+)$", 2).alias("f"),
        F.regexp_extract(code, r"^R-(\d+)\\([A-Z0-9]+)-(\d+)$", 3).alias("n"), "value").where("r <> ''")
    pick = {name: F.max(F.when(F.col("f") == name, F.col("value"))) for name in ("TK1", "CHE", "DSI", "CDLN", "PDLN", "CDT")}
    wide = field.groupBy("source_id", "r", "n").agg(*[c.alias(k) for k, c in pick.items()])
    enabled = F.upper(trimmed(F.coalesce("CHE", F.lit(""))))
    kind = trimmed(F.col("CDT"))
    link = F.coalesce(F.nullif("CDLN", F.lit("")), F.nullif("PDLN", F.lit("")))
    sources = wide.select(
        "source_id", F.col("r").cast("int").alias("r"), F.col("n").cast("int").alias("n"), parse_int(F.col("TK1")).alias("channel_id"),
        F.coalesce(F.nullif("DSI", F.lit("")), link, F.lit("")).alias("name"), link.alias("link"),
        F.when(kind.isin("11", TIME_TYPE), TIME_TYPE).when(kind.isin("01", "09", PCM_TYPE), PCM_TYPE).otherwise(F.coalesce(kind, F.lit(""))).alias("type"),
        enabled.isin("", "T", "TRUE", "Y", "1").alias("enabled")).where("enabled and channel_id >= 0")
    p_code = r"^P-(\d+)\\(DLN|D2)$"
    p_rows = attributes.select("source_id", F.regexp_extract(code, p_code, 1).alias("p"), F.regexp_extract(code, p_code, 2).alias("f"), "value").where("p <> ''")
    rates = (p_rows.groupBy("source_id", "p").agg(F.max(F.when(F.col("f") == "DLN", F.col("value"))).alias("link"),
                                                 F.max(F.when(F.col("f") == "D2", parse_double(F.col("value")))).alias("rate"))
             .where("rate > 0").groupBy("source_id", "link").agg(F.max_by("rate", -F.col("p").cast("int")).alias("bit_rate_bps")))
    rated = sources.join(rates, ["source_id", "link"], "left")
    at = F.struct("r", "n")
    return rated.groupBy("source_id", "channel_id").agg(
        F.max_by("name", F.when(F.col("name") != "", at)).alias("name"), F.max_by("type", F.when(F.col("type") != "", at)).alias("type"),
        F.lit(True).alias("enabled"), F.coalesce(F.min_by("bit_rate_bps", F.when(F.col("bit_rate_bps") > 0, at)), F.lit(0.0)).alias("bit_rate_bps")
    ).withColumns({"name": F.coalesce("name", F.lit("")), "type": F.coalesce("type", F.lit(""))})


# --- quality gates and census ---------------------------------------------------------------------------------------------

def recording_gates(packets: DataFrame, attributes: DataFrame | None = None, key: str = "source_id") -> DataFrame:
    """One row per broken assertion of a recording (``gate``), by one pass over packet headers."""
    kind = F.col("data_type")
    facts = packets.groupBy(key).agg(F.min_by("data_type", "file_offset").alias("first_type"), F.max("packet_len").alias("longest"),
                                     F.bool_or(kind == PCM).alias("pcm"), F.bool_or(kind == TIME).alias("time"))
    tests = {"first_packet_not_tmats": F.col("first_type") != TMATS, "packet_too_large": F.col("longest") > MAX_PACKET_BYTES,
             "no_pcm": ~F.col("pcm"), "no_time": ~F.col("time")}
    if attributes is not None:
        code = F.upper("code")
        track = code.rlike(r"^R-\d+\\TK1-\d+$")
        held = attributes.groupBy(key).agg(F.bool_or(code.startswith("G\\")).alias("g"), F.bool_or(code.startswith("R-")).alias("r"),
                                           F.count_if(track).alias("tracks"), F.count_if(track & parse_int(F.col("value")).isNull()).alias("bad"))
        facts = facts.join(held, key, "left").na.fill({"g": False, "r": False, "tracks": 0, "bad": 0})
        tests |= {"no_g_record": ~F.col("g"), "no_r_record": ~F.col("r"), "no_tracks": F.col("tracks") == 0, "track_not_numeric": F.col("bad") > 0}
    broken = F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()])
    return facts.select(key, F.explode(F.filter(broken, lambda g: g.isNotNull())).alias("gate"))


def packet_census(packets: DataFrame, keys: list[str] | None = None, kind: str = "data_type", channel: str = "channel_id") -> DataFrame:
    """Packets per data type and channel; ``place`` ranks a type's channels, the busiest first, and ``packets`` counts the type."""
    keys = keys if keys is not None else ["source_id"]
    per = packets.groupBy(*keys, kind, channel).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(*keys, kind).agg(F.sum("n").alias("packets"), F.count(F.lit(1)).alias("channels"))
    ranked = per.withColumn("place", F.row_number().over(W.partitionBy(*keys, kind).orderBy(F.desc("n"), channel)))
    return ranked.join(total, [*keys, kind]).select(*keys, kind, "packets", "channels", "place", channel, "n")


# --- routing and time -----------------------------------------------------------------------------------------------------

def route_packets(packets: DataFrame, streams: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Each packet once for every stream configured on its channel; other packets drop out.

    Stream tables are small and are sent to every task: a shuffle by channel would gather a busy channel's packets in one.
    """
    on = on or ["source_id", "channel_id"]
    return packets.join(per_stream(streams.select("stream_id", *on)), on)


def time_ticks(payload: Column) -> Column:
    """Absolute 100 ns ticks of a time packet (format 1): day-of-year times count from 1970, dated times from their year.

    The fields are binary-coded digits, so they are read off the hex text.
    """
    digits = F.hex(payload)

    def word(byte: int, mask_high: int = 0xF) -> list[Column]:
        low = F.conv(F.substring(digits, 2 * byte + 2, 1), 16, 10).cast("int")
        high = F.conv(F.substring(digits, 2 * byte + 1, 1), 16, 10).cast("int").bitwiseAND(mask_high)
        return [low, high]

    body = CSDW_BYTES
    hundredths, tenths = word(body)
    sec, ten_sec = word(body + 1, 0x7)
    minute, ten_min = word(body + 2, 0x7)
    hour, ten_hour = word(body + 3, 0x3)
    of_day = (ten_hour * 10 + hour) * 3600 + (ten_min * 10 + minute) * 60 + ten_sec * 10 + sec
    dated = F.conv(F.substring(digits, 4, 1), 16, 10).cast("int").bitwiseAND(2) == 2
    day, ten_day = word(body + 4)
    hundred_day = F.conv(F.substring(digits, 2 * (body + 5) + 2, 1), 16, 10).cast("int").bitwiseAND(0x3)
    since_new_year = hundred_day * 100 + ten_day * 10 + day - 1
    month, ten_month = word(body + 5, 0x1)
    year, ten_year = word(body + 6)
    hundred_year, thousand_year = word(body + 7, 0x3)
    date = F.try_make_timestamp(thousand_year * 1000 + hundred_year * 100 + ten_year * 10 + year, ten_month * 10 + month, ten_day * 10 + day,
                                F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    days = F.when(dated, F.floor(F.unix_micros(date) / 86_400_000_000)).otherwise(since_new_year)
    return ((days * 86400 + of_day).cast("long") * TICKS_PER_SECOND + (tenths * 10 + hundredths) * (TICKS_PER_SECOND // 100)).cast("long")


def time_packets(packets: DataFrame, time_channels: DataFrame) -> DataFrame:
    """Time packets of each source's chosen time channel: ``source_id, file_offset, rel_time_100ns, abs_ticks``."""
    wanted = time_channels.select("source_id", F.col("time_channel_id").alias("channel_id"))
    return packets.where(F.col("data_type") == TIME).join(wanted, ["source_id", "channel_id"]).select(
        "source_id", "file_offset", "channel_id", "rel_time_100ns", time_ticks(F.col("payload")).alias("abs_ticks"))


def packet_time(packets: DataFrame, times: DataFrame) -> DataFrame:
    """Absolute base time of every packet, from the latest time packet before it in the file (the first one before any).

    Only slim rows take part: no payload is sorted.
    """
    shift = times.select("source_id", "file_offset", (F.col("abs_ticks") - F.col("rel_time_100ns")).alias("shift"))
    slim = packets.select(*[c for c in packets.columns if c != "payload"])
    found = asof_backward(slim, shift, ["source_id"], ["file_offset"], ["shift"], offset_chunk(), fallback_first=True)
    return found.withColumn("base_ticks", F.col("rel_time_100ns") + F.col("shift")).drop("shift")


def time_gaps(times: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, ticks: str = "abs_ticks",
              limit: int = GAP_TICKS, chunk: Column | None = None) -> DataFrame:
    """How many neighbouring time packets lie more than the limit apart, per source."""
    keys, order = keys or ["source_id"], order or ["file_offset"]
    cut = chunk if chunk is not None else (offset_chunk() if order == ["file_offset"] else None)
    near = ordered_scan(times, keys, order, [Carry("_prev", F.col(ticks), "last", inclusive=False)], cut)
    return near.groupBy(*keys).agg(F.count_if(F.col(ticks) - F.col("_prev") > limit).alias("gaps"))


def pcm_packets(packets: DataFrame, streams: DataFrame, times: DataFrame, chunk_bytes: int = OFFSETS_PER_CHUNK) -> DataFrame:
    """What the bit operators take: routed payloads without their 4-byte channel word, timed, in file order.

    ``chunk`` is the byte range of the file a packet starts in, so a chunk's payload is bounded however busy its channel is. The
    time join is on slim rows, joined back by position.
    """
    pcm = packets.where((F.col("data_type") == PCM) & (F.octet_length("payload") > CSDW_BYTES))
    timed = packet_time(pcm.select("source_id", "file_offset", "rel_time_100ns"), times).select("source_id", "file_offset", "base_ticks")
    body = F.expr(f"substring(payload, {CSDW_BYTES + 1})")
    return (route_packets(pcm.select("source_id", "channel_id", "file_offset", body.alias("payload")), streams)
            .join(timed, ["source_id", "file_offset"])
            .select("stream_id", F.col("file_offset").alias("ord"), offset_chunk("file_offset", chunk_bytes).alias("chunk"),
                    (8 * F.octet_length("payload")).cast("long").alias("n_bits"), "base_ticks", "payload"))
