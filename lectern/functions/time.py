"""Times and intervals in microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def ttml_time(x: Column | str) -> Column:
    """A TTML time expression: clock time with an optional fraction, or an offset in h, m, s, ms or ticks
    of 100 ns. Null if malformed or null."""
    c = F.trim(_c(x))
    part = lambda k: F.regexp_extract(c, r"^(?:(\d+)\.)?(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,7}))?$", k)
    num = lambda k: F.coalesce(part(k).try_cast("long"), F.lit(0))
    ticks = F.rpad(part(5), 7, "0").try_cast("long")
    clock = ((num(1) * 24 + num(2)) * 3600 + num(3) * 60 + num(4)) * SECOND + F.coalesce(F.floor(ticks / 10), F.lit(0))
    value = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)(h|m|s|ms|t)$", 1).try_cast("decimal(28,9)")
    unit = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)(h|m|s|ms|t)$", 2)
    scale = F.when(unit == "h", 3600 * SECOND).when(unit == "m", 60 * SECOND).when(unit == "s", SECOND).when(unit == "ms", 1000).cast("decimal(18,1)")
    offset = F.when(unit == "t", F.floor(value / 10)).otherwise(F.floor(value * scale)).cast("long")
    return F.when(part(3) != "", clock).when(unit != "", offset).cast("long")


def vtt_time(x: Column | str) -> Column:
    """``[hours:]mm:ss.fff``; null if malformed."""
    pattern = r"^(?:(\d{2,}):)?([0-5]\d):([0-5]\d)\.(\d{3})$"
    num = lambda k: F.coalesce(F.regexp_extract(F.trim(_c(x)), pattern, k).try_cast("long"), F.lit(0))
    total = ((num(1) * 60 + num(2)) * 60 + num(3)) * SECOND + num(4) * 1000
    return F.when(F.trim(_c(x)).rlike(pattern), total)


def _known(us: Column | str, pattern: str, *parts: Column) -> Column:
    """The formatted parts of a time; null stays null, which format_string would spell out."""
    return F.when(_c(us).isNotNull(), F.format_string(pattern, *parts))


def format_vtt(us: Column | str, comma: bool = False) -> Column:
    """``HH:MM:SS.mmm``, or with a comma as SRT has it."""
    ms = F.floor(_c(us) / 1000)
    return _known(us, "%02d:%02d:%02d" + ("," if comma else ".") + "%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def format_clock(us: Column | str) -> Column:
    """``HH:MM:SS`` by total hours, truncated."""
    s = F.floor(_c(us) / SECOND)
    return _known(us, "%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def overlap(s: Column | str, e: Column | str, s2: Column | str, e2: Column | str) -> Column:
    return F.least(_c(e), _c(e2)) - F.greatest(_c(s), _c(s2))


def midpoint_cue(start: Column | str, end: Column | str, most: int = 100_000) -> Column:
    """A short cue that begins half-way: a struct (start_us, end_us)."""
    mid = F.floor((_c(start) + _c(end)) / 2)
    return F.struct(mid.alias("start_us"), F.least(_c(end), mid + most).alias("end_us"))


def iso_utc(ts: Column | str) -> Column:
    """``yyyy-mm-ddThh:mm:ssZ`` of a time in UTC."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def year_of(first: Column | str, second: Column | str) -> Column:
    return F.coalesce(F.year(_c(first)), F.year(_c(second)))
