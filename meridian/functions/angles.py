"""Angles as native columns: radians inside, degrees-minutes-seconds, gon and packed notations at the edges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def wrap_to_2pi(angle) -> Column:
    """[0, 2 pi); a remainder that rounds up to 2 pi becomes 0."""
    r = F.pmod(_c(angle), F.lit(TWO_PI))
    return F.when(r >= TWO_PI, F.lit(0.0)).otherwise(r)


def wrap_to_pi(angle) -> Column:
    """(-pi, pi]."""
    return F.lit(math.pi) - wrap_to_2pi(F.lit(math.pi) - _c(angle))


def angular_difference(first, second) -> Column:
    return wrap_to_pi(_c(first) - _c(second))


def circular_mean(angle) -> Column:
    """An aggregate: the mean direction in [0, 2 pi); null where there is no row or the directions cancel."""
    s, c = F.sum(F.sin(_c(angle))), F.sum(F.cos(_c(angle)))
    return F.when((F.abs(s) >= 1e-12) | (F.abs(c) >= 1e-12), wrap_to_2pi(F.atan2(s, c)))


def dms_to_radians(degrees, minutes, seconds) -> Column:
    """The sign is that of the degrees."""
    d = _c(degrees)
    size = F.abs(d) + _c(minutes) / 60.0 + _c(seconds) / 3600.0
    return F.radians(F.when(d < 0, -size).otherwise(size))


def radians_to_dms(angle, decimals: int = 4) -> Column:
    """struct(sign, degrees, minutes, seconds); seconds that round to 60 carry upward."""
    value = F.degrees(_c(angle))
    total = F.round(F.abs(value) * 3600.0, decimals)
    degrees = F.floor(total / 3600.0)
    minutes = F.floor((total - degrees * 3600) / 60.0)
    return F.struct(
        F.when(value < 0, -1).otherwise(1).alias("sign"),
        degrees.cast("int").alias("degrees"),
        minutes.cast("int").alias("minutes"),
        F.round(total - degrees * 3600 - minutes * 60, decimals).alias("seconds"),
    )


def format_dms(angle, decimals: int = 2) -> Column:
    """Text such as -12-05-07.25, as sign, degrees, minutes and seconds joined by dashes."""
    p = radians_to_dms(angle, decimals)
    width = 3 + decimals if decimals else 2
    seconds = F.lpad(F.format_string(f"%.{decimals}f", p.seconds), width, "0")
    return F.concat(F.when(p.sign < 0, "-").otherwise(""), p.degrees.cast("string"), F.lit("-"), F.lpad(p.minutes.cast("string"), 2, "0"), F.lit("-"), seconds)


def packed_to_radians(value) -> Column:
    """DDD.MMSSsss, by the digits of its text so that binary rounding can't move a minute."""
    text = F.format_string("%.10f", F.abs(_c(value)))
    whole, rest = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    seconds = F.concat(F.substring(rest, 3, 2), F.lit("."), F.substring(rest, 5, 6)).cast("double")
    size = whole.cast("double") + F.substring(rest, 1, 2).cast("double") / 60.0 + seconds / 3600.0
    return F.radians(F.when(_c(value) < 0, -size).otherwise(size))


def radians_to_packed(angle, decimals: int = 4) -> Column:
    """DDD.MMSSsss as a number."""
    p = radians_to_dms(angle, decimals)
    return p.sign * (p.degrees + p.minutes / 100.0 + p.seconds / 10000.0)


def parse_angle(text, default_unit: str = "degree") -> Column:
    """Radians of text: three numbers parted by blanks, dashes, colons or degree signs; a number with a trailing
    g or gon, r or rad, or d or deg; or a bare number in `default_unit` (degree, gon, radian or packed).
    Null where it can't be read."""
    t = F.lower(F.trim(_c(text)))
    number = r"([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)"
    dms = r"^([+-]?)(\d+)\s*[°d:\s-]\s*(\d{1,2})\s*['′m:\s-]\s*(\d{1,2}(?:\.\d*)?)(?:\s*(?:\"|″|'')|s)?\s*([nsew]?)$"
    part = lambda k: F.regexp_extract(t, dms, k)
    size = F.radians(part(2).try_cast("double") + part(3).try_cast("double") / 60.0 + part(4).try_cast("double") / 3600.0)
    signed = F.when((part(1) == "-") | part(5).isin("s", "w"), -size).otherwise(size)
    valid = (part(3).try_cast("double") < 60) & (part(4).try_cast("double") < 60)
    bare = lambda suffix: F.regexp_extract(t, f"^{number}\\s*(?:{suffix})$", 1).try_cast("double")
    factor = {"degree": math.pi / 180, "gon": math.pi / 200, "radian": 1.0}
    plain = bare("")
    default = packed_to_radians(plain) if default_unit == "packed" else plain * factor[default_unit]
    return F.when(t.rlike(dms), F.when(valid, signed)).otherwise(
        F.coalesce(bare("g|gon") * factor["gon"], bare("r|rad") * factor["radian"], bare("d|deg|°") * factor["degree"], default)
    )
