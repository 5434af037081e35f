"""Text forms of instants, ages, values and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passband.functions.bits import floor_div

NEVER = "never"

# The words reports and exports use.
LIMIT_LABELS = {0: "—", 1: "ok", 2: "WARN", 3: "ALARM"}
SEVERITY_LETTERS = {0: "I", 1: "W", 2: "E"}
REFUSALS = {
    "short_field": "field past the end of the packet",
    "unrecognized": "packet type not described",
    "ambiguous": "ambiguous packet type",
    "enumeration": "value outside its enumeration",
    "calibration": "calibration refused its input",
    "text": "invalid text",
}

#: Octets shown of a binary value in a table cell, and in an export.
CELL_PREVIEW = 8
EXPORT_PREVIEW = 16


def label(column: Column, words: dict) -> Column:
    """Look a small fixed vocabulary up; null for anything outside it."""
    pairs = [F.lit(part) for item in words.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), column)


def civil(nanos: Column) -> Column:
    """UTC calendar parts of a nanosecond instant, before 1970 included."""
    stamp = F.timestamp_micros(floor_div(nanos, 1000))
    return F.struct(
        F.year(stamp).alias("year"),
        F.month(stamp).alias("month"),
        F.day(stamp).alias("day"),
        F.hour(stamp).alias("hour"),
        F.minute(stamp).alias("minute"),
        F.second(stamp).alias("second"),
        F.pmod(nanos, F.lit(1_000_000_000)).cast("int").alias("nanos"),
    )


def iso_micros(micros: Column) -> Column:
    """ISO-8601 to the millisecond (truncated), from microseconds since 1970."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso(nanos: Column) -> Column:
    """ISO-8601 to the millisecond (truncated towards the past), from nanoseconds since 1970."""
    return iso_micros(floor_div(nanos, 1000))


def age(seconds: Column) -> Column:
    """A signed age: s, m, h or d; one decimal below ten; ``never`` for null."""
    size = F.abs(seconds)
    scaled = (
        F.when(size < 60, seconds)
        .when(size < 3600, seconds / 60)
        .when(size < 86_400, seconds / 3600)
        .otherwise(seconds / 86_400)
    )
    unit = F.when(size < 60, "s").when(size < 3600, "m").when(size < 86_400, "h").otherwise("d")
    tenths = _exact_tenths(F.abs(scaled))
    sign = F.when(scaled < 0, "-").otherwise("")
    digits = F.when(
        F.abs(scaled) < 10, F.concat(sign, (tenths / 10).cast("decimal(20,1)").cast("string"))
    ).otherwise(F.rint(scaled).cast("decimal(20,0)").cast("string"))
    return F.coalesce(F.concat(digits, F.lit(" "), unit), F.lit(NEVER))


def _exact_tenths(x: Column) -> Column:
    """Tenths of a double of 0 to 10, rounded by its exact value, ties to even.

    Ten times a double is seldom a double, and its digits as printed are not its value.  The product
    is taken in two halves that are exact, so that the side of the tie it lies on is known.
    """
    high = (x * 134_217_729.0) - ((x * 134_217_729.0) - x)  # the upper half of the digits
    product = x * 10.0
    rest = (high * 10.0 - product) + (x - high) * 10.0
    whole = F.floor(product)
    side = ((product - whole) - 0.5) + rest
    up = (side > 0) | ((side == 0) & (whole % 2 == 1))
    return whole + F.when(up, 1).otherwise(0)


def hex_preview(octets: Column, preview: int = CELL_PREVIEW) -> Column:
    """Lower-case hex of the first octets, with the length when some are left out."""
    head = F.lower(F.hex(F.substring(octets, 1, preview)))
    more = F.concat(head, F.lit("… ("), F.length(octets).cast("string"), F.lit(" bytes)"))
    return F.when(F.length(octets) > preview, more).otherwise(head)


def float_text(number: Column) -> Column:
    """Shortest text of a double without exponent or a trailing ``.0``; it reads back as the same double."""
    # A double's own digits come from its string cast; only the exponent has to be written out.
    text = number.cast("string")
    plain = F.regexp_replace(text, r"\.0$", "")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)E", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "0+$", "")
    power = F.when(plain.contains("E"), F.regexp_extract(text, r"E(-?[0-9]+)$", 1)).cast("int")
    whole = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, "0")
    rest = F.substring(digits, power + 2, F.length(digits))
    wide = F.when(
        power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    ).otherwise(F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise("")))
    special = F.when(F.isnan(number), "NaN").when(number == float("inf"), "inf").when(
        number == float("-inf"), "-inf"
    )
    return F.coalesce(special, F.when(plain.contains("E"), F.concat(sign, wide)).otherwise(plain))


def value_text(value: Column, preview: int = EXPORT_PREVIEW) -> Column:
    """Text of a tagged value struct."""
    return F.coalesce(
        value["i"].cast("string"),
        float_text(value["f"]),
        value["b"].cast("string"),
        value["s"],
        hex_preview(value["x"], preview),
    )


def value_parts(value: Column, preview: int = EXPORT_PREVIEW) -> Column:
    """A tagged value as its text, or the number whose text is still to be written: see :func:`parts_text`."""
    plain = F.coalesce(
        value["i"].cast("string"), value["b"].cast("string"), value["s"], hex_preview(value["x"], preview)
    )
    return F.struct(plain.alias("text"), value["f"].alias("number"))


def parts_text(parts: Column) -> Column:
    """:func:`value_text` of the value that was taken apart."""
    return F.coalesce(parts["text"], float_text(parts["number"]))


def value_with_unit(value: Column, unit: Column, preview: int = CELL_PREVIEW) -> Column:
    """The value's text, then a space and the unit where there is one."""
    text = value_text(value, preview)
    return F.when(F.length(unit) > 0, F.concat(text, F.lit(" "), unit)).otherwise(text)
