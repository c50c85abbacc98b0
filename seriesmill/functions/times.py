"""Times as columns: microsecond keys, calendar buckets, parsing and formatting.

Keys are BIGINT microseconds since 1970-01-01. A TIMESTAMP_NTZ counts as UTC wall time; a
TIMESTAMP is an instant, and a zone name is only needed for wall-clock work on it.
"""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strftime directives that have a Spark date pattern.
STRFTIME = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%j": "DDD",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%F": "yyyy-MM-dd",
    "%T": "HH:mm:ss",
    "%R": "HH:mm",
    "%D": "MM/dd/yy",
    "%f": "SSSSSSSSS",
    "%3f": "SSS",
    "%6f": "SSSSSS",
    "%9f": "SSSSSSSSS",
    "%.3f": ".SSS",
    "%.6f": ".SSSSSS",
    "%.9f": ".SSSSSSSSS",
}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00", "Etc/GMT"}
EPOCH = dt.datetime(1970, 1, 1)


def _session_is_utc() -> bool:
    return SparkSession.active().conf.get("spark.sql.session.timeZone") in _UTC_NAMES


def is_instant(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.TimestampType)


def to_us(x: Column, instant: bool = False) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ (or, with *instant*, a TIMESTAMP)."""
    if instant:
        return F.unix_micros(x)
    if _session_is_utc():  # the cast is free and stays in generated code
        return F.unix_micros(x.cast("timestamp"))
    return F.timestamp_diff("MICROSECOND", time_literal(0), x)


def from_us(us: Column, instant: bool = False) -> Column:
    if instant:
        return F.timestamp_micros(us)
    if _session_is_utc():
        return F.timestamp_micros(us).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", us, time_literal(0))


def time_literal(us: int, instant: bool = False) -> Column:
    """A foldable time, so that comparisons with it are pushed into the scan."""
    if instant:
        return F.timestamp_micros(F.lit(us))
    text = (EPOCH + dt.timedelta(microseconds=us)).strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0")
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def wall_time(x: Column, instant: bool, zone: str | None) -> Column:
    """The local wall time as TIMESTAMP_NTZ."""
    if not instant:
        return x
    return F.convert_timezone(F.lit("UTC"), F.lit(zone or "UTC"), from_us(F.unix_micros(x)))


def shift(x: Column, us: int, instant: bool = False) -> Column:
    if instant or _session_is_utc():
        return from_us(to_us(x, instant) + F.lit(us), instant)
    return F.timestamp_add("MICROSECOND", F.lit(us), x)


# -- calendar buckets ---------------------------------------------------------------


def fixed_bucket_us(us: Column, width: int, origin: int = 0) -> Column:
    """Start of the *width* microseconds long bucket that holds *us* (floored, also before 1970)."""
    return us - F.pmod(us - F.lit(origin), F.lit(width))


def month_bucket(wall: Column, months: int) -> Column:
    """Start of a bucket of whole months, counted from January 1970."""
    number = (F.year(wall) - 1970) * 12 + F.month(wall) - 1
    first = number - F.pmod(number, F.lit(months))
    return F.add_months(F.lit(dt.date(1970, 1, 1)), first.cast("int")).cast("timestamp_ntz")


def zoned_bucket(x: Column, zone: str, truncate) -> Column:
    """Buckets of a TIMESTAMP on the wall clock of *zone*, given back as instants.

    Where a clock change makes the bucket start ambiguous, the row's own offset decides.
    """
    wall = wall_time(x, True, zone)
    start = truncate(wall)
    offset = to_us(wall) - F.unix_micros(x)
    own = F.timestamp_micros(to_us(start) - offset)
    usual = F.timestamp_micros(to_us(F.convert_timezone(F.lit(zone), F.lit("UTC"), start)))
    return F.when(wall_time(own, True, zone) == start, own).otherwise(usual)


# -- parsing --------------------------------------------------------------------------

# Groups: 1 the date and time, 5 the offset, 6 its sign, 7 its hours, 8 its minutes.
_ISO_TEXT = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?)?)"
    r"\s*([Zz]|([+-])([0-9]{2})(?::?([0-9]{2}))?)?$"
)

_PLAIN_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


def iso_text_to_us(text: Column, zone: str | None = None) -> Column:
    """ISO 8601 text, or epoch seconds, to microseconds; NULL where it is neither.

    Text without an offset is UTC wall time, or wall time in *zone* when one is given.
    """
    text = F.trim(text)

    def group(number: int) -> Column:
        return F.regexp_extract(text, _ISO_TEXT, number)

    # More than six fraction digits are cut off.
    stamp = F.regexp_replace(F.replace(group(1), F.lit(","), F.lit(".")), r"(\.[0-9]{6})[0-9]+$", "$1")
    wall = stamp.try_cast("timestamp_ntz")
    minutes = F.coalesce(group(7).try_cast("int") * 60 + F.coalesce(group(8).try_cast("int"), F.lit(0)), F.lit(0))
    away = minutes.cast("bigint") * 60_000_000
    utc = to_us(wall) - F.when(group(6) == "-", -away).otherwise(away)
    if zone:
        local = to_us(F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))
        utc = F.when(group(5) == "", local).otherwise(utc)
    other = F.coalesce(utc, F.round(text.try_cast("double") * 1e6).cast("bigint"))
    if zone:
        return other
    # The usual form needs no taking apart.
    return F.when(text.rlike(_PLAIN_ISO), to_us(text.try_cast("timestamp_ntz"))).otherwise(other)


def bound_us(value: str | float | dt.datetime, zone: str | None) -> int:
    """One range bound of a job as epoch microseconds (driver side)."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return round(value * 1e6)
    if isinstance(value, dt.datetime):
        moment = value
    else:
        text = str(value).strip().replace(",", ".")
        if "." in text:  # at most microseconds
            head, tail = text.split(".", 1)
            digits = tail[: len(tail) - len(tail.lstrip("0123456789"))]
            text = f"{head}.{digits[:6].ljust(6, '0')}{tail[len(digits):]}"
        moment = dt.datetime.fromisoformat(text)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=ZoneInfo(zone) if zone else dt.timezone.utc)
    delta = moment - EPOCH.replace(tzinfo=dt.timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


# -- formatting -----------------------------------------------------------------------


def date_pattern(strftime: str) -> str:
    """A Spark date pattern for a strftime pattern; ValueError for directives Spark lacks."""
    out, literal, i = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""

    while i < len(strftime):
        if strftime[i] != "%":
            literal += strftime[i]
            i += 1
            continue
        if strftime[i : i + 2] == "%%":
            literal += "%"
            i += 2
            continue
        known = next((strftime[i : i + n] for n in (4, 3, 2) if strftime[i : i + n] in STRFTIME), None)
        if known is None:
            raise ValueError(f"The time format {strftime!r} has a directive that is not supported at position {i}")
        flush()
        out.append(STRFTIME[known])
        i += len(known)
    flush()
    return "".join(out)


# Directives that stand for others.
STRFTIME_WORDS = {
    "%h": "%b", "%c": "%a %b %e %H:%M:%S %Y", "%x": "%m/%d/%y", "%X": "%H:%M:%S", "%r": "%I:%M:%S %p", "%v": "%e-%b-%Y", "%n": "\n", "%t": "\t",
    "%e": "%_d", "%k": "%_H", "%l": "%_I",
}
#: Numeric directives that take another padding, and the fewest digits of each.
PADDED = {"d": 2, "m": 2, "y": 2, "j": 3, "H": 2, "I": 2, "M": 2, "S": 2, "V": 2, "U": 2, "W": 2, "C": 2, "g": 2, "u": 1, "w": 1, "Y": 4, "G": 4}


def strftime_text(x: Column, strftime: str, instant: bool, zone: str | None) -> Column:
    """x as text by a strftime pattern; ValueError for a directive that is none or needs a zone that x has not."""
    for _ in range(2):  # one of them stands for another
        for word, meaning in STRFTIME_WORDS.items():
            strftime = re.sub(f"(?<!%)((?:%%)*){re.escape(word)}", lambda m, meaning=meaning: m[1] + meaning, strftime)
    wall = wall_time(x, instant, zone)
    parts, plain = [], ""
    for token in re.findall(r"%[-_0]?(?:\.?[369]?f|:?z|.)|[^%]+|%", strftime, re.DOTALL):
        special = _directive(token, x, wall, instant)
        if special is None:
            plain += token
            continue
        if plain:
            parts.append(F.date_format(wall, date_pattern(plain)))
        parts.append(special)
        plain = ""
    if plain or not parts:
        parts.append(F.date_format(wall, date_pattern(plain)))
    return F.concat(*parts)


def _directive(token: str, x: Column, wall: Column, instant: bool) -> Column | None:
    """The text of a directive that has no Spark pattern, or None."""
    if token in STRFTIME or not token.startswith("%") or token == "%%":
        return None
    if token in ("%z", "%:z"):
        if not instant:
            raise ValueError(f"The directive {token} needs times with a zone")
        return _offset(x, wall, ":" if token == "%:z" else "")
    if token == "%s":
        return F.floor((F.unix_micros(x) if instant else to_us(x)) / 1_000_000).cast("string")
    if token == "%P":
        return F.lower(F.date_format(wall, "a"))
    if token == "%.f":  # as many groups of three digits as needed
        return F.regexp_replace(F.date_format(wall, ".SSSSSS"), r"^\.000000$|(?<=^\.\d{3})000$", "")
    pad, name = (token[1], token[2:]) if token[1] in "-_0" else ("", token[1:])
    if name not in PADDED:
        return None
    day = F.date_trunc("day", wall)
    week = lambda first: F.floor((F.dayofyear(wall) + 6 - F.pmod(F.weekday(wall) + (1 - first), F.lit(7))) / 7)
    iso_year = F.year(F.date_add(day.cast("date"), F.lit(3) - F.weekday(wall)))
    number = {
        "d": lambda: F.dayofmonth(wall), "m": lambda: F.month(wall), "y": lambda: F.pmod(F.year(wall), F.lit(100)), "j": lambda: F.dayofyear(wall),
        "H": lambda: F.hour(wall), "I": lambda: F.pmod(F.hour(wall) + 11, F.lit(12)) + 1, "M": lambda: F.minute(wall), "S": lambda: F.second(wall),
        "V": lambda: F.weekofyear(wall), "U": lambda: week(0), "W": lambda: week(1), "C": lambda: F.floor(F.year(wall) / 100),
        "G": lambda: iso_year, "g": lambda: F.pmod(iso_year, F.lit(100)), "u": lambda: F.weekday(wall) + 1, "w": lambda: F.pmod(F.weekday(wall) + 1, F.lit(7)),
        "Y": lambda: F.year(wall),
    }[name]().cast("string")
    return number if pad == "-" else F.lpad(number, F.greatest(F.length(number), F.lit(PADDED[name])), F.lit(" " if pad == "_" else "0"))


def _offset(x: Column, wall: Column, colon: str = "") -> Column:
    """How far the wall time is ahead of UTC, as +hhmm."""
    away = F.floor((to_us(wall) - F.unix_micros(x)) / 60_000_000)
    size = F.abs(away)
    return F.concat(F.when(away < 0, "-").otherwise("+"), F.format_string(f"%02d{colon}%02d", F.floor(size / 60), F.pmod(size, F.lit(60))))


def iso_text(x: Column, instant: bool, zone: str | None) -> Column:
    """ISO 8601 text with six fraction digits, and the offset of a zoned column."""
    if not instant:
        return F.date_format(x, ISO)
    wall = wall_time(x, True, zone)
    return F.concat(F.date_format(wall, ISO), _offset(x, wall))
