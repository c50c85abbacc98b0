"""Duration texts such as ``1h30m``: for job settings (driver) and for text columns (Spark)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds per unit. Months, quarters and years are the approximations that
# estimates use; calendar buckets count months instead.
UNIT_US = {
    "ns": 0.001,
    "us": 1.0,
    "µs": 1.0,
    "ms": 1_000.0,
    "s": 1_000_000.0,
    "m": 60_000_000.0,
    "h": 3_600_000_000.0,
    "d": 86_400_000_000.0,
    "w": 604_800_000_000.0,
    "mo": 2_592_000_000_000.0,
    "q": 7_862_400_000_000.0,
    "y": 31_536_000_000_000.0,
}
# Months per calendar unit.
UNIT_MONTHS = {"mo": 1, "q": 3, "y": 12}

_UNITS = "|".join(sorted(UNIT_US, key=len, reverse=True))
PART = rf"([0-9]+(?:\.[0-9]+)?)({_UNITS})"
WHOLE = rf"^(?:{PART})+$"


def split_duration(text: str) -> list[tuple[float, str]]:
    """``"1h30m"`` as ``[(1.0, "h"), (30.0, "m")]``; ValueError when it is not a duration."""
    text = text.strip()
    if not re.match(WHOLE, text):
        raise ValueError(f"{text!r} is not a duration; write numbers with units, such as 500ms, 1m or 1h30m")
    return [(float(number), unit) for number, unit in re.findall(PART, text)]


def is_duration(text: str) -> bool:
    return re.match(WHOLE, text.strip()) is not None


def duration_us(text: str) -> float:
    return sum(number * UNIT_US[unit] for number, unit in split_duration(text))


def offset_seconds(value: float | str) -> float:
    """An offset in seconds: a number, or a duration text with an optional leading minus."""
    if isinstance(value, bool):
        raise ValueError(f"{value!r} is not an offset")
    if not isinstance(value, str):
        return float(value)
    try:
        return float(value)
    except ValueError:
        pass
    text = value.strip()
    negative = text.startswith("-")
    seconds = duration_us(text[1:] if negative else text) / 1e6
    return -seconds if negative else seconds


def text_to_seconds(text: Column) -> Column:
    """Offset text to seconds, NULL where the text is neither a number nor a duration."""
    text = F.trim(text)
    body = F.trim(F.regexp_replace(text, "^-", ""))
    units = F.create_map(*[F.lit(v) for pair in UNIT_US.items() for v in pair])
    numbers = F.regexp_extract_all(body, F.lit(PART), F.lit(1))
    names = F.regexp_extract_all(body, F.lit(PART), F.lit(2))
    parts = F.zip_with(numbers, names, lambda n, u: n.try_cast("double") * F.element_at(units, u))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p) / F.lit(1e6)
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.coalesce(text.try_cast("double"), F.when(body.rlike(WHOLE), signed))


def _trim_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _six_digits(value: Column) -> Column:
    """A non-negative number below 60 with six significant digits."""
    power = F.floor(F.log10(value)).cast("int")
    plain = F.lit(None).cast("string")
    for exponent in (1, 0, -1, -2, -3, -4):
        pattern = "0." + "0" * (5 - exponent)
        plain = F.when(power == exponent, F.call_function("format_number", value, F.lit(pattern))).otherwise(plain)
    scaled = F.call_function("format_number", value / F.pow(F.lit(10.0), power), F.lit("0.00000"))
    tiny = F.concat(_trim_zeros(scaled), F.format_string("e-%02d", -power))
    return F.when(value == 0, "0").when(power < -4, tiny).otherwise(_trim_zeros(plain))


def seconds_to_clock(seconds: Column) -> Column:
    """``12.25 s`` below a minute, ``01:02:03.5`` above it, ``2d 01:02:03`` above a day."""
    size = F.abs(seconds)
    days = F.floor(size / 86400)
    hours = F.floor((size - days * 86400) / 3600)
    minutes = F.floor((size - days * 86400 - hours * 3600) / 60)
    rest = size - days * 86400 - hours * 3600 - minutes * 60
    tail = _trim_zeros(F.call_function("format_number", rest, F.lit("00.000")))
    clock = F.concat(F.format_string("%02d:%02d:", hours, minutes), tail)
    text = (
        F.when(size < 60, F.concat(_six_digits(size), F.lit(" s")))
        .when(days > 0, F.concat(days.cast("string"), F.lit("d "), clock))
        .otherwise(clock)
    )
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (size != F.lit(float("inf")))
    return F.when(~finite, "").otherwise(F.concat(F.when(seconds < 0, "-").otherwise(""), text))


def seconds_to_compact(seconds: Column) -> Column:
    """Seconds as a duration text such as ``1h2m3s500ms`` (exact to the microsecond)."""
    rest = F.round(F.abs(seconds) * 1e6).cast("bigint")
    texts = []
    for unit in ("d", "h", "m", "s", "ms", "us"):
        size = int(UNIT_US[unit])
        count = F.floor(rest / size) if size > 1 else rest
        texts.append(F.when(count > 0, F.concat(count.cast("string"), F.lit(unit))))
        rest = F.pmod(rest, F.lit(size))
    body = F.concat_ws("", *texts)
    return F.when(seconds == 0, "0s").otherwise(F.concat(F.when(seconds < 0, "-").otherwise(""), body))
