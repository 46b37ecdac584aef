"""Scalar expressions: identifiers, codes, text folding and UTM coordinates. (§2.8)"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "àâäáãåāăąçćĉċčďéèêëēĕėęěĝğġģĥíìîïĩīĭįĵķĺļľñńņňóòôöõōŏőŕŗřśŝşšţťúùûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzz"

NUMERIC = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def number_or_null(text: Column) -> Column:
    """A decimal number, else null; type suffixes and decimal commas are not numbers."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMERIC), trimmed.try_cast("double"))


def state_code(text: Column) -> Column:
    """The code of a value that is no number: digits in brackets, else the text itself."""
    trimmed = F.trim(text)
    digits = F.regexp_extract(trimmed, r"\[(\d+)\]", 1)
    return F.when(~trimmed.rlike(NUMERIC), F.when(digits != "", digits).otherwise(trimmed))


def fold_accents(text: Column) -> Column:
    """Lower case, trimmed and without the accents of Latin letters, whether they are part of the letter or marks after it."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{Mn}+", ""))


def general_number(value: Column) -> Column:
    """A number with six significant digits and no needless zeros, as C's ``%g`` writes it."""
    shown = F.format_string("%.5e", value.cast("double"))
    mantissa, exponent = F.substring_index(shown, "e", 1), F.substring_index(shown, "e", -1).cast("int")
    short = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(short(mantissa), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(value == 0, "0").when((exponent < -4) | (exponent >= 6), scientific).otherwise(short(shown.cast("decimal(20,10)").cast("string")))


def split_faults(text: Column) -> Column:
    """Parts between plus signs, trimmed, without empty ones. (Q-11: the separator is literal)"""
    return F.filter(F.transform(F.split(text, r"\+"), lambda x: F.trim(x)), lambda x: x != "")


def normalise_faults(text: Column, names: dict[str, str | None]) -> Column:
    """Fault names mapped by their folded form; unknown ones stay, names mapped to null go."""
    known = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    keys = F.array(*[F.lit(k) for k in names])
    mapped = F.transform(split_faults(text), lambda x: F.when(F.array_contains(keys, fold_accents(x)), F.element_at(known, fold_accents(x))).otherwise(x))
    return F.filter(mapped, lambda x: x.isNotNull())


def excel_date(serial: Column) -> Column:
    """The date of a spreadsheet's day number; null if it is none."""
    return F.expr("date'1899-12-30'") + F.floor(number_or_null(serial)).cast("int")


def file_date(name: Column) -> Column:
    """The time in a telemetry file's name, else null. (FLT-07)"""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(?i)^\d+_(\d{14})\.mis$", 1), F.lit("")), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def file_station(name: Column) -> Column:
    """The station in a telemetry file's name, else null. (FLT-07)"""
    return F.nullif(F.regexp_extract(name, r"(?i)^(\d+)_\d{14}\.mis$", 1), F.lit(""))


def geographic(east: Column, north: Column, zone: int = 32, south: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of transverse Mercator coordinates in metres, in a zone of six degrees on WGS84.

    Krüger's series in the third flattening n, to its fourth power: the rectified coordinates give
    conformal ones, and the conformal latitude is turned into the geographic one by its own series.
    """
    flattening, scale = 1 / 298.257223563, 0.9996
    n = flattening / (2 - flattening)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # The published coefficients of the inverse series and of the latitude.
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    up = (north - (10_000_000.0 if south else 0.0)) / (scale * radius)
    side = (east - 500_000.0) / (scale * radius)
    xi = up - sum((b * F.sin(2 * k * up) * F.cosh(2 * k * side) for k, b in enumerate(beta, 1)), F.lit(0.0))
    eta = side - sum((b * F.cos(2 * k * up) * F.sinh(2 * k * side) for k, b in enumerate(beta, 1)), F.lit(0.0))
    conformal = F.asin(F.sin(xi) / F.cosh(eta))
    latitude = conformal + sum((d * F.sin(2 * k * conformal) for k, d in enumerate(delta, 1)), F.lit(0.0))
    return F.degrees(latitude), F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183)
