"""Strict text rules as Column expressions: numbers, clock stamps, series headers, receiver names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# How exported tables spell things.
TIME_HEADER = "Time (DOY:HH:MM:SS.mmm)"
LOCK_SUFFIX = " Lock (%)"
MISSED_SUFFIX = " Accumulated Missed Frames"
ID_SEPARATOR = " - "
PREFIXES = ["L", "R", "C"]
LOCK, MISSED, LEVEL = "lock", "missed", "level"

_SPACE = " \t\n\u000b\f\r"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def parse_int(text: Column) -> Column:
    """A whole decimal 32-bit number with one optional sign, else null."""
    t = trimmed(text)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("int"))


def parse_hex(text: Column) -> Column:
    """Unsigned hex of at most 64 bits (optional plus and 0x) as a signed long with the same bits, else null."""
    digits = F.regexp_extract(trimmed(text), r"^\+?(?:0[xX])?([0-9A-Fa-f]+)$", 1)
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when((digits != "") & (F.length(short) <= 16), F.conv(short, 16, -10).cast("long"))


def parse_double(text: Column) -> Column:
    """A decimal or exponent number, nan, inf, +inf or -inf; anything else is null."""
    t = trimmed(text)
    word = F.lower(t)
    special = (F.when(word == "nan", F.lit(float("nan"))).when(word.isin("inf", "+inf"), F.lit(float("inf")))
               .when(word == "-inf", F.lit(float("-inf"))))
    number = t.try_cast("double")
    # Out of range is not a number here, where a cast would give infinity; a non-zero text that becomes 0 is out of range too.
    fits = ~number.isin(float("inf"), float("-inf")) & ((number != 0) | ~F.split_part(F.lower(t), F.lit("e"), F.lit(1)).rlike("[1-9]"))
    return F.coalesce(special, F.when(t.rlike(_NUMBER) & fits, number))


@F.pandas_udf(StringType())
def format_fixed6(value: pd.Series) -> pd.Series:
    """Six decimals from the exact binary value, ties away from zero; a negative that rounds to zero keeps its sign.

    Only an odd number of 128ths lies exactly between two six-decimal numbers.
    """
    def text(v: float | None) -> str | None:
        if v is None:
            return None
        if v != v:
            return "nan"
        size = abs(v)
        body = f"{size:.6f}"
        if size < 1e9 and (size * 128) % 2 == 1:
            whole = int(size * 128) * 15625 + 1  # twice the millionths, rounded up
            body = f"{whole // 2 // 10**6}.{whole // 2 % 10**6:06d}"
        return "-" + body if v < 0 else body

    return value.astype(object).where(value.notna() | (value != value), None).map(text)


def round_millis(seconds: Column) -> Column:
    """Whole milliseconds, halves away from zero, by adding a half and truncating."""
    ms = seconds * 1000.0
    return F.when(ms >= 0, F.floor(ms + 0.5)).otherwise(F.ceil(ms - 0.5)).cast("long")


def clock_stamp(day: Column, offset: Column, elapsed: Column, millis: bool = True) -> Column:
    """``DDD:HH:MM:SS[.mmm]`` of an elapsed time after (day of year, seconds after midnight); negative totals borrow a day."""
    total = offset + elapsed
    days = F.when(total >= 0, F.floor(total / 86400)).otherwise(F.ceil(total / 86400))
    rest = total - days * 86400
    days = day + days + F.when(rest < 0, -1).otherwise(0)
    rest = F.when(rest < 0, rest + 86400).otherwise(rest)
    whole = F.floor(rest)
    parts = [days.cast("int"), F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"), (whole % 60).cast("int")]
    if not millis:
        return F.format_string("%03d:%02d:%02d:%02d", *parts)
    return F.format_string("%03d:%02d:%02d:%02d.%03d", *parts, F.floor((rest - whole) * 1000 + 0.5).cast("int"))


def parse_stamp(text: Column) -> Column:
    """``DDD:HH:MM:SS.mmm`` as struct(day, seconds); null unless exactly four good fields."""
    parts = F.split(text, ":", -1)
    day, hour, minute = (parse_int(F.try_element_at(parts, F.lit(i))) for i in (1, 2, 3))
    second = parse_double(F.try_element_at(parts, F.lit(4)))
    good = (F.size(parts) == 4) & day.isNotNull() & hour.isNotNull() & minute.isNotNull() & second.isNotNull()
    return F.when(good, F.struct(day.alias("day"), (hour * 3600.0 + minute * 60.0 + second).alias("seconds")))


def stamp_to_elapsed(text: Column, day: Column, offset: Column) -> Column:
    """A typed ``DDD:HH:MM:SS`` on the elapsed axis; 0 for other text, and 0 for a field that is not a whole number."""
    parts = F.split(text, ":", -1)
    field = [F.coalesce(parse_int(F.try_element_at(parts, F.lit(i))), F.lit(0)) for i in (1, 2, 3, 4)]
    entered = field[0] * 86400.0 + field[1] * 3600.0 + field[2] * 60.0 + field[3]
    return F.when(F.size(parts) == 4, entered - (day * 86400.0 + offset)).otherwise(0.0)


# --- names ------------------------------------------------------------------------------------------------------------

def receiver_prefix(channel: Column) -> Column:
    """L, R, C, then CH4, CH5 ..."""
    known = F.try_element_at(F.array(*[F.lit(p) for p in PREFIXES]), channel.cast("int") + 1)
    return F.coalesce(known, F.concat(F.lit("CH"), (channel + 1).cast("string")))


def receiver_number(name: Column) -> Column:
    """The whole decimal number after the last ``_RCVR``, or 0."""
    after = F.substring_index(name, "_RCVR", -1)
    return F.when(F.contains(name, F.lit("_RCVR")), F.coalesce(parse_int(after), F.lit(0))).otherwise(0)


def channel_part(name: Column) -> Column:
    """The name before the last ``_RCVR<n>`` (n above 0), else the whole name."""
    head = F.substring(name, F.lit(1), F.length(name) - F.length(F.substring_index(name, "_RCVR", -1)) - 5)
    return F.when((receiver_number(name) > 0) & (head != ""), head).otherwise(name)


def level_series_name(channel_id: Column, label: Column, channel: Column) -> Column:
    return F.concat(channel_id.cast("string"), F.lit(ID_SEPARATOR), label, F.lit(" "), channel)


def column_header(metric: Column, name: Column, source: Column) -> Column:
    """A series' export header; only sources after the first are qualified."""
    base = F.concat(name, F.when(metric == LOCK, LOCK_SUFFIX).when(metric == MISSED, MISSED_SUFFIX).otherwise(""))
    return F.when(source == 0, base).otherwise(F.concat(F.lit("S"), source.cast("string"), F.lit("| "), base))


def parse_header(header: Column) -> Column:
    """struct(metric, name, stream_label, stream_order, receiver, source_id): the inverse of ``column_header``.

    The shape of a level series (digits, then " - ") wins over a lock or missed suffix.
    """
    source = parse_int(F.regexp_extract(header, r"^S([0-9]+)\| ", 1))
    body = F.when(source.isNotNull(), F.regexp_replace(header, r"^S[0-9]+\| ", "")).otherwise(header)
    level_shape = body.rlike("^[0-9]+ - ")
    is_lock = ~level_shape & F.endswith(body, F.lit(LOCK_SUFFIX))
    is_missed = ~level_shape & ~is_lock & F.endswith(body, F.lit(MISSED_SUFFIX))
    metric = F.when(is_lock, LOCK).when(is_missed, MISSED).otherwise(LEVEL)
    bare = (F.when(is_lock, F.left(body, F.length(body) - len(LOCK_SUFFIX)))
            .when(is_missed, F.left(body, F.length(body) - len(MISSED_SUFFIX))))
    dash = F.instr(body, ID_SEPARATOR)
    rest = F.when(dash > 1, F.substring(body, dash + len(ID_SEPARATOR), F.length(body)))
    label = F.coalesce(F.nullif(F.regexp_extract(rest, r"(?s)^(.+) [^ ]*$", 1), F.lit("")), rest, F.lit(""))
    order = F.when(dash > 1, F.coalesce(parse_int(F.left(body, dash - 1)), F.lit(0))).otherwise(0)
    level = metric == LEVEL
    return F.struct(metric.alias("metric"), F.coalesce(bare, body).alias("name"),
                    F.coalesce(bare, label).alias("stream_label"), F.when(level, order).otherwise(0).alias("stream_order"),
                    F.when(level, receiver_number(body)).otherwise(0).alias("receiver"),
                    F.coalesce(source, F.lit(0)).alias("source_id"))


def legend_label(metric: Column, name: Column, order: Column, channel: Column, receiver: Column) -> Column:
    """A level series' short name, ``CH<id> <L|R|C|n>_RCVR<n>``; other series keep theirs."""
    letter = F.coalesce(F.try_element_at(F.array(*[F.lit(p) for p in PREFIXES]), channel.cast("int") + 1), (channel + 1).cast("string"))
    short = F.concat(F.lit("CH"), order.cast("string"), F.lit(" "), letter, F.lit("_RCVR"), receiver.cast("string"))
    return F.when(metric == LEVEL, short).otherwise(name)


def base_name(file_name: Column) -> Column:
    """A file name up to its first dot."""
    return F.substring_index(file_name, ".", 1)


def stream_label_column(label: Column, channel: Column) -> Column:
    """A stream's label, else ``Ch <id>``."""
    return F.when(F.coalesce(label, F.lit("")) == "", F.concat(F.lit("Ch "), channel.cast("string"))).otherwise(label)
