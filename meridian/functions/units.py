"""Units, epochs and calendar arithmetic as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor to the SI unit of each dimension.
FACTORS = {
    "length": {"metre": 1.0, "kilometre": 1000.0, "centimetre": 0.01, "millimetre": 0.001, "foot": 0.3048, "us_survey_foot": 1200.0 / 3937.0},
    "angle": {"radian": 1.0, "degree": 0.017453292519943295, "gon": 0.015707963267948967, "arcminute": 0.0002908882086657216, "arcsecond": 4.84813681109536e-06},
    "acceleration": {"m_s2": 1.0, "gal": 0.01, "mgal": 1e-5, "ugal": 1e-8},
    "time": {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0},
    "pressure": {"pascal": 1.0, "hectopascal": 100.0, "millibar": 100.0, "mmhg": 133.322387415},
}
ZERO_CELSIUS = 273.15


def dimension_of(unit: str) -> str:
    for dimension, units in FACTORS.items():
        if unit in units:
            return dimension
    raise ValueError(f"unknown unit {unit!r}")


def convert(value: Column, from_unit: str, to_unit: str) -> Column:
    """Within one dimension; anything else is refused when the plan is built."""
    if (d := dimension_of(from_unit)) != dimension_of(to_unit):
        raise ValueError(f"{from_unit!r} and {to_unit!r} are of different dimensions")
    return value * (FACTORS[d][from_unit] / FACTORS[d][to_unit])


def celsius_to_kelvin(value: Column) -> Column:
    """Null below absolute zero."""
    return F.when(value >= -ZERO_CELSIUS, value + ZERO_CELSIUS)


def decimal_year(instant: Column) -> Column:
    year = F.year(instant)
    start, end = F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(year + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return year + (F.unix_micros(instant) - F.unix_micros(start)) / (F.unix_micros(end) - F.unix_micros(start))


def gps_week(day: Column) -> Column:
    """struct(week, day of the week with Sunday 0), from 1980-01-06."""
    days = F.datediff(day, F.to_date(F.lit("1980-01-06")))
    return F.struct(F.floor(days / 7).cast("int").alias("week"), F.pmod(days, F.lit(7)).cast("int").alias("day"))


def printed_sigma(text: Column) -> Column:
    """The sigma that the printed decimals of a number imply: half a unit of the last place over sqrt 3; 0.5 for empty text."""
    decimals = F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)
    return F.when(F.trim(text) == "", F.lit(0.5)).otherwise(0.5 * F.pow(F.lit(10.0), -decimals) / F.sqrt(F.lit(3.0)))
