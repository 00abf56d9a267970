"""Total-station reductions and computations as native columns.

pointings: setup, target, set, face (D direct, R reverse), horizontal, zenith, distance and their variances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.angles import wrap_to_2pi, wrap_to_pi
from meridian.functions.uncertainty import Q
from meridian.functions.uncertainty import cos as q_cos
from meridian.functions.uncertainty import sin as q_sin

#: Refraction coefficient and its sigma, Earth's radius, standard temperature and pressure, water-vapour term.
REFRACTION, REFRACTION_SIGMA, EARTH_RADIUS = 0.13, 0.05, 6371000.0
STANDARD_TEMPERATURE, STANDARD_PRESSURE, WATER_VAPOUR = 273.15, 101325.0, 0.1127


def first_pointings(pointings: DataFrame, order: str = "row") -> DataFrame:
    """Of several pointings on one face in a set, the first."""
    w = Window.partitionBy("setup", "target", "set", "face").orderBy(order)
    return pointings.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def face_pairs(pointings: DataFrame) -> DataFrame:
    """Both faces of a set side by side; a face that is missing is null."""
    per = lambda face, c: F.max(F.when(F.col("face") == face, F.col(c))).alias(f"{c}_{face.lower()}")
    return pointings.groupBy("setup", "target", "set").agg(*(per(f, c) for f in "DR" for c in ("horizontal", "zenith", "distance")))


def reduce_face_pairs(pairs: DataFrame, distance_sigma: float = 0.0) -> DataFrame:
    """Horizontal, zenith, distance, collimation and vertical index of pairs with both faces."""
    both = pairs.where("horizontal_d is not null and horizontal_r is not null")
    collimation = wrap_to_pi(F.col("horizontal_d") - F.col("horizontal_r") + math.pi) / 2.0
    gap = F.abs(F.col("distance_d") - F.col("distance_r"))
    return both.withColumns({
        "collimation": collimation,
        "horizontal": wrap_to_2pi(F.col("horizontal_d") - collimation),
        "zenith": (F.col("zenith_d") - F.col("zenith_r") + 2 * math.pi) / 2.0,
        "vertical_index": (F.col("zenith_d") + F.col("zenith_r") - 2 * math.pi) / 2.0,
        "distance": (F.col("distance_d") + F.col("distance_r")) / 2.0,
        "distance_disagrees": F.lit(distance_sigma > 0) & (gap > 3.0 * math.sqrt(2.0) * distance_sigma),
    })


def setup_diagnostics(reductions: DataFrame) -> DataFrame:
    spread = lambda c: F.max(c) - F.min(c)
    return reductions.groupBy("setup").agg(F.count("*").alias("pairs"), F.avg("collimation").alias("collimation"), spread("collimation").alias("collimation_spread"), F.avg("vertical_index").alias("vertical_index"), spread("vertical_index").alias("vertical_index_spread"))


def saturation_pressure(kelvin: Column) -> Column:
    c = kelvin - STANDARD_TEMPERATURE
    return 611.2 * F.exp(17.62 * c / (243.12 + c))


def group_refractivity(wavelength_um: float) -> float:
    return 287.6155 + 4.88660 / wavelength_um**2 + 0.06800 / wavelength_um**4


def refractive_index(kelvin: Column, pascal: Column, humidity: Column, wavelength_um: float = 0.850) -> Column:
    dry = group_refractivity(wavelength_um) * STANDARD_TEMPERATURE / STANDARD_PRESSURE
    return 1.0 + 1e-6 * (dry * pascal / kelvin - WATER_VAPOUR * humidity * saturation_pressure(kelvin) / kelvin)


def atmospheric_correction(distance: Column, index: Column, reference_index: float, applied: Column) -> Column:
    """The distance in the measured air; one that is marked as corrected passes."""
    return F.when(applied, distance).otherwise(distance * reference_index / index)


def edm_correction(distance: Column, additive: float, scale: float, amplitude: float = 0.0, wavelength: float = 1.0, phase: float = 0.0) -> Column:
    d = (distance + additive) * scale
    return d - amplitude * F.sin(2 * math.pi * d / wavelength + phase)


def reduce_basic(distance: Q, zenith: Q, instrument_height: Q, target_height: Q) -> dict[str, Q]:
    """Horizontal distance and height difference of a sight. The two share distance and zenith, so each is propagated from the
    readings themselves."""
    up = distance * q_cos(zenith)
    return {"horizontal": distance * q_sin(zenith), "vertical": up, "height_difference": up + instrument_height - target_height}


def curvature_and_refraction(horizontal: Column, k: float = REFRACTION, radius: float = EARTH_RADIUS) -> Column:
    return (1.0 - k) * horizontal * horizontal / (2.0 * radius)


def to_ellipsoid(horizontal: Column, mean_height: Column, undulation: float = 0.0, radius: float = EARTH_RADIUS) -> Column:
    return horizontal * radius / (radius + mean_height + undulation)


def line_scale(start: Column, middle: Column, end: Column) -> Column:
    """Simpson's mean of point scale factors along a line."""
    return (start + 4.0 * middle + end) / 6.0


def leapfrog(sights: DataFrame, k: float = REFRACTION, radius: float = EARTH_RADIUS) -> DataFrame:
    """Height difference from the backward to the forward target of a setup (direction B or F): distance, zenith, target_height."""
    side = lambda d, e: F.max(F.when(F.col("direction") == d, e))
    horizontal = F.col("distance") * F.sin("zenith")
    rise = F.col("distance") * F.cos("zenith") + curvature_and_refraction(horizontal, k, radius) - F.col("target_height")
    sums = sights.groupBy("setup").agg(side("F", rise).alias("f"), side("B", rise).alias("b"), side("F", horizontal).alias("df"), side("B", horizontal).alias("db"))
    return sums.where("f is not null and b is not null").select("setup", (F.col("f") - F.col("b")).alias("height_difference"), (F.col("df") - F.col("db")).alias("imbalance"))


def traverse(legs: DataFrame, start_azimuth: str = "start_azimuth", method: str = "compass") -> DataFrame:
    """legs: traverse, seq, angle, distance with the traverse's start_azimuth, start_x, start_y and, to close, close_azimuth,
    close_x, close_y. Azimuths and coordinates are running sums; the angular misclosure is spread equally, the linear one by
    distance (compass), by the legs' own components (transit) or not at all (none)."""
    w = Window.partitionBy("traverse").orderBy("seq")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("traverse")
    raw = F.col(start_azimuth) + F.sum(F.col("angle") + math.pi).over(running)
    legs = legs.withColumn("raw_azimuth", raw).withColumn("legs", F.count("*").over(whole)).withColumn("nth", F.row_number().over(w))
    angular = wrap_to_pi(F.last("raw_azimuth").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.col("close_azimuth"))
    legs = legs.withColumn("angular_misclosure", F.coalesce(angular, F.lit(0.0)))
    legs = legs.withColumn("azimuth", wrap_to_2pi(F.col("raw_azimuth") - F.col("angular_misclosure") * F.col("nth") / F.col("legs")))
    legs = legs.withColumns({"de": F.col("distance") * F.sin("azimuth"), "dn": F.col("distance") * F.cos("azimuth")})
    legs = legs.withColumns({
        "perimeter": F.sum("distance").over(whole),
        "miss_x": F.coalesce(F.col("start_x") + F.sum("de").over(whole) - F.col("close_x"), F.lit(0.0)),
        "miss_y": F.coalesce(F.col("start_y") + F.sum("dn").over(whole) - F.col("close_y"), F.lit(0.0)),
    })
    share = {
        "compass": (F.sum("distance").over(running) / F.col("perimeter"),) * 2,
        "transit": (F.sum(F.abs("de")).over(running) / F.sum(F.abs("de")).over(whole), F.sum(F.abs("dn")).over(running) / F.sum(F.abs("dn")).over(whole)),
        "none": (F.lit(0.0),) * 2,
    }[method]
    return legs.withColumns({
        "x": F.col("start_x") + F.sum("de").over(running) - F.col("miss_x") * share[0],
        "y": F.col("start_y") + F.sum("dn").over(running) - F.col("miss_y") * share[1],
        "misclosure": F.sqrt(F.col("miss_x") ** 2 + F.col("miss_y") ** 2),
    }).drop("raw_azimuth", "nth", "legs")


def radiate(sights: DataFrame) -> DataFrame:
    """Polar points: station_x, station_y, station_z, orientation, horizontal, zenith, distance, instrument_height, target_height."""
    azimuth = wrap_to_2pi(F.col("orientation") + F.col("horizontal"))
    flat = F.col("distance") * F.sin("zenith")
    return sights.withColumns({
        "x": F.col("station_x") + flat * F.sin(azimuth),
        "y": F.col("station_y") + flat * F.cos(azimuth),
        "z": F.col("station_z") + F.col("instrument_height") + F.col("distance") * F.cos("zenith") - F.col("target_height"),
    })


def intersections(sightings: DataFrame) -> DataFrame:
    """Forward intersection: target, x, y, azimuth, variance of each ray. The rays are lines, whose weighted least squares in the plane is
    a 2 x 2 system of sums; two rounds weight the rays by their length. (target, rays, x, y, semi axes' ratio)."""
    nx, ny = F.cos("azimuth"), -F.sin("azimuth")  # normal of the ray

    def meet(rows: DataFrame, weight: Column) -> DataFrame:
        c = nx * F.col("x") + ny * F.col("y")
        s = rows.groupBy("target").agg(F.count("*").alias("rays"), *(F.sum(weight * e).alias(n) for n, e in (("a", nx * nx), ("b", nx * ny), ("d", ny * ny), ("p", nx * c), ("q", ny * c))))
        det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
        trace = F.col("a") + F.col("d")
        root = F.sqrt(F.greatest(trace * trace / 4.0 - det, F.lit(0.0)))
        good = det > 1e-12 * trace * trace  # else the rays are parallel
        return s.select("target", "rays", F.when(good, (F.col("p") * F.col("d") - F.col("q") * F.col("b")) / det).alias("tx"), F.when(good, (F.col("a") * F.col("q") - F.col("b") * F.col("p")) / det).alias("ty"), F.when(good, F.sqrt((trace / 2.0 + root) / (trace / 2.0 - root))).alias("axis_ratio"))

    first = meet(sightings, 1.0 / F.col("variance"))
    again = sightings.join(first.select("target", F.col("tx").alias("near_x"), F.col("ty").alias("near_y")), "target")
    length2 = (F.col("near_x") - F.col("x")) ** 2 + (F.col("near_y") - F.col("y")) ** 2
    return meet(again, 1.0 / (F.col("variance") * length2)).select("target", "rays", F.col("tx").alias("x"), F.col("ty").alias("y"), "axis_ratio")


def resections(directions: DataFrame, rounds: int = 20) -> DataFrame:
    """Position and orientation of each station from directions to known points: station, x, y, direction, variance,
    approximate_x, approximate_y. One small iterated system a station; on the danger circle it is null."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = float(rows.approximate_x.iloc[0]), float(rows.approximate_y.iloc[0])
        px, py, d, w = (rows[c].to_numpy(float) for c in ("x", "y", "direction", "variance"))
        w = 1.0 / w
        o = float(np.angle(np.exp(1j * (np.arctan2(px - x, py - y) - d)).mean()))
        good = len(rows) >= 3
        for _ in range(rounds if good else 0):
            dx, dy = px - x, py - y
            s2 = dx * dx + dy * dy
            a = np.stack((-dy / s2, dx / s2, -np.ones_like(dx)), axis=1)
            l = np.angle(np.exp(1j * (d - (np.arctan2(dx, dy) - o))))
            n = a.T @ (w[:, None] * a)
            scaled = n / np.sqrt(np.outer(np.diag(n), np.diag(n)))
            if np.linalg.cond(scaled) > 1e12:
                good = False
                break
            step = np.linalg.solve(n, a.T @ (w * l))
            x, y, o = x + step[0], y + step[1], o + step[2]
            if np.abs(step[:2]).max() < 1e-6:
                break
        nan = float("nan")
        return pd.DataFrame({"station": [rows.station.iloc[0]], "sights": [len(rows)], "x": [x if good else nan], "y": [y if good else nan], "orientation": [o % (2 * math.pi) if good else nan]}).astype({"x": "Float64", "y": "Float64", "orientation": "Float64"})

    return directions.groupBy("station").applyInPandas(one, "station string, sights long, x double, y double, orientation double")
