"""Values as CSV cell text, and text helpers for names and paths."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(value: Column) -> Column:
    """The shortest text that reads back as the same double, plain from 1e-5 up to 1e16."""
    text, size = value.cast("string"), F.abs(value)
    usual = value.isNull() | (value == 0) | ((size >= 1e-3) & (size < 1e7))
    # Spark writes the rest with a power of ten: spell it out, or shorten it to 1e20.
    digits = F.rtrim(value.cast("decimal(38,24)").cast("string"), F.lit("0"))
    large = F.rtrim(value.cast("decimal(38,12)").cast("string"), F.lit("0"))
    spelled = F.when(size < 1, digits).otherwise(large)
    spelled = F.when(spelled.endswith("."), F.concat(spelled, F.lit("0"))).otherwise(spelled)
    power = F.lower(F.replace(text, F.lit(".0E"), F.lit("E")))
    odd = F.when(F.isnan(value), "NaN").when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
    plain = (size >= 1e-5) & (size < 1e16)
    return F.when(usual, text).otherwise(F.coalesce(odd, F.when(plain, spelled).otherwise(power)))


#: Below this size, a double times a power of ten is off by less than NEAR.
EXACT, NEAR = float(1 << 44), 2.0**-8


def fixed_text(value: Column, digits: int) -> Column:
    """A fixed number of decimals, rounded half-even on the exact binary value.

    The value times a power of ten is rounded to a whole number, which is the text as a decimal. The product carries an error, so
    values whose product is near a half, large ones and those that round to zero go through the slower exact form.
    """
    pattern = "0." + "0" * digits if digits else "0"
    text = F.call_function("format_number", value, F.lit(pattern))
    odd = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    exact = F.when(~odd, text).otherwise(F.when(F.isnan(value), "NaN").when(value > 0, "inf").when(value < 0, "-inf"))
    if digits > 6:
        return exact
    scaled = value * F.lit(float(10**digits))
    plain = (F.abs(scaled) < EXACT) & (F.abs(scaled) >= 0.5) & (F.abs(scaled - F.floor(scaled) - 0.5) > NEAR)
    whole = F.rint(scaled).cast("bigint")
    number = (whole.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-digits))).cast("string") if digits else whole.cast("string")
    return F.when(plain, number).otherwise(exact)


def readout_text(value: Column) -> Column:
    """A number as a plot shows it: six significant digits, four decimals and a power of ten below 0.001 and from ten million on.

    Halves are rounded to even on the exact binary value, up to whole numbers of 2**53.
    """
    size = F.abs(value)
    far = (size >= 1e7) | (size < 1e-3)
    # As many decimals as six digits leave; the pattern drops zeros at the end.
    pattern = F.when(far, "0.0000E0").when(size >= 999999.5, "0.#####E0")
    for decimals in range(9):
        pattern = pattern.when(size >= 10.0 ** (5 - decimals), "0." + "#" * decimals if decimals else "0")
    # With a power of ten, Java rounds halves of whole numbers up: those before an even digit are made a little less.
    step = F.pow(F.lit(10.0), F.floor(F.log10(size)) - F.when(far, 4).otherwise(5))
    half = (size >= 999999.5) & (F.pmod(size, step) * 2 == step) & (F.pmod(F.floor(size / step), F.lit(2)) == 0)
    text = F.call_function("format_number", F.when(half, size - 1).otherwise(size), pattern.otherwise("0"))
    mantissa, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    digits = F.replace(power, F.lit("-"), F.lit(""))
    text = F.when(text.contains("E"), F.concat(mantissa, F.lit("e"), sign, F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0")))).otherwise(text)
    finite = value.isNotNull() & ~F.isnan(value) & (size != float("inf"))
    minus = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    return F.when(finite, F.concat(minus, F.when(size == 0, "0").otherwise(text))).otherwise("–")


def decimal_comma(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit(","))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def cell(text: Column, style: str, separator: str, null_value: str, textual: bool) -> Column:
    """Quote one cell. *textual* marks cells that are not numbers; NULL becomes *null_value*."""
    null = F.lit(null_value)
    if style == "never":
        return F.coalesce(text, null)
    if style == "always":
        return quoted(F.coalesce(text, null))
    if style == "non_numeric":
        return F.coalesce(quoted(text) if textual else text, null)
    special = (
        text.contains('"') | text.contains(separator) | text.contains("\n") | text.contains("\r") | (text == "")
    )
    return F.coalesce(F.when(special, quoted(text)).otherwise(text), null)


def safe_label(label: Column) -> Column:
    """A range label as part of a file name; kept when nothing of it would be left."""
    clean = F.regexp_replace(label, r"(?U)[^\w.-]+", "_")
    clean = F.regexp_replace(clean, "^_+|_+$", "")
    return F.when(clean == "", label).otherwise(clean)


def path_parts(path: Column) -> dict[str, Column]:
    """The placeholders of an output template: name, stem, parent and dir of a path."""
    name = F.substring_index(path, "/", -1)
    folder = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))
    # A leading dot belongs to the stem: ".data" has no suffix.
    stem = F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
    return {
        "name": name,
        "stem": stem,
        "dir": folder,
        "parent": F.when(folder == ".", "").otherwise(F.substring_index(folder, "/", -1)),
    }
