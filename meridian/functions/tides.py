"""The solid-Earth tide by Longman's closed formulas (1959), as native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The gravimetric factor and the model's standard uncertainty, m/s^2.
AMPLIFICATION, SIGMA = 1.16, 1.5e-8
#: Fixed values of the paper, in SI units: masses, gravitation, distances, orbit.
GRAVITATION, MOON_MASS, SUN_MASS = 6.670e-11, 7.3537e22, 1.993e30
ECCENTRICITY, MOTION_RATIO = 0.054899720, 0.074804
MOON_DISTANCE, SUN_DISTANCE, EQUATOR = 3.84402e8, 1.495e11, 6.378270e6
#: Mean elements as arc seconds at the epoch, a century, a century squared and cubed; and revolutions a century.
ELEMENTS = {
    "moon": ((270 * 3600 + 26 * 60 + 11.72, 1108406.05, 7.128, 0.0072), 1336),
    "perigee": ((334 * 3600 + 19 * 60 + 46.42, 392522.51, -37.15, -0.036), 11),
    "sun": ((279 * 3600 + 41 * 60 + 48.05, 129602768.11, 1.080, 0.0), 0),
    "node": ((259 * 3600 + 10 * 60 + 57.12, -482912.63, 7.58, 0.008), -5),
    "sun_perigee": ((281 * 3600 + 13 * 60 + 15.0, 6189.03, 1.63, 0.012), 0),
}
_SECOND = math.pi / 648000.0
_INCLINATION = math.radians(5 + 8 / 60 + 43.3546 / 3600)
_OBLIQUITY = math.radians(23 + 27 / 60 + 8.26 / 3600)
#: Seconds from 1899-12-31 12:00 to 1970-01-01 00:00.
_ORIGIN = 2209032000.0


def _element(name: str, t: Column) -> Column:
    (c0, c1, c2, c3), turns = ELEMENTS[name]
    return c0 * _SECOND + t * ((turns * 2 * math.pi + c1 * _SECOND) + t * (c2 * _SECOND + t * (c3 * _SECOND)))


def _zenith_cosine(latitude: Column, tilt: Column, longitude_in_orbit: Column, right_ascension: Column) -> Column:
    half = tilt / 2.0
    return F.sin(latitude) * F.sin(tilt) * F.sin(longitude_in_orbit) + F.cos(latitude) * (
        F.pow(F.cos(half), 2.0) * F.cos(longitude_in_orbit - right_ascension) + F.pow(F.sin(half), 2.0) * F.cos(longitude_in_orbit + right_ascension)
    )


def tidal_correction(instant: Column, latitude: Column, longitude: Column, height: Column, amplification: float = AMPLIFICATION) -> Column:
    """What to add to a reading, m/s^2: `instant` is a timestamp (an instant in itself), angles in radians, east positive."""
    seconds = F.unix_micros(instant) / 1e6
    t = (seconds + _ORIGIN) / (36525.0 * 86400.0)
    hours = F.pmod(seconds, F.lit(86400.0)) / 3600.0
    s, p, h, node, p1 = (_element(k, t) for k in ("moon", "perigee", "sun", "node", "sun_perigee"))
    e1 = 0.01675104 - t * (0.00004180 + t * 0.000000126)
    e, m = ECCENTRICITY, MOTION_RATIO

    cos_tilt = math.cos(_INCLINATION) * math.cos(_OBLIQUITY) - math.sin(_INCLINATION) * math.sin(_OBLIQUITY) * F.cos(node)
    tilt = F.acos(cos_tilt)
    nu = F.asin(math.sin(_INCLINATION) * F.sin(node) / F.sin(tilt))
    alpha = F.atan2(math.sin(_OBLIQUITY) * F.sin(node) / F.sin(tilt), F.cos(node) * F.cos(nu) + F.sin(node) * F.sin(nu) * math.cos(_OBLIQUITY))
    orbit = (
        (s - (node - alpha))
        + 2 * e * F.sin(s - p)
        + 1.25 * e * e * F.sin(2.0 * (s - p))
        + 3.75 * m * e * F.sin(s - 2.0 * h + p)
        + 1.375 * m * m * F.sin(2.0 * (s - h))
    )
    meridian = (hours - 12.0) * (math.pi / 12.0) + longitude + h
    cos_moon = _zenith_cosine(latitude, tilt, orbit, meridian - nu)
    cos_sun = _zenith_cosine(latitude, F.lit(_OBLIQUITY), h + 2.0 * e1 * F.sin(h - p1), meridian)

    r = EQUATOR * F.sqrt(1.0 / (1.0 + 0.006738 * F.pow(F.sin(latitude), 2.0))) + height
    to_moon = 1.0 / MOON_DISTANCE + (1.0 / (MOON_DISTANCE * (1.0 - e * e))) * (
        e * F.cos(s - p) + e * e * F.cos(2.0 * (s - p)) + 1.875 * m * e * F.cos(s - 2.0 * h + p) + m * m * F.cos(2.0 * (s - h))
    )
    to_sun = 1.0 / SUN_DISTANCE + e1 * F.cos(h - p1) / (SUN_DISTANCE * (1.0 - e1 * e1))
    moon = GRAVITATION * MOON_MASS * (r * F.pow(to_moon, 3.0) * (3.0 * cos_moon * cos_moon - 1.0) + 1.5 * r * r * F.pow(to_moon, 4.0) * (5.0 * F.pow(cos_moon, 3.0) - 3.0 * cos_moon))
    sun = GRAVITATION * SUN_MASS * r * F.pow(to_sun, 3.0) * (3.0 * cos_sun * cos_sun - 1.0)
    return amplification * (moon + sun)
