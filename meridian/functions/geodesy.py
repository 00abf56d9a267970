"""Geodesy as native columns: ellipsoids, Cartesian and local coordinates, Helmert transformations, transverse Mercator."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.uncertainty import transform


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2.0 - self.f)

    @property
    def n(self) -> float:
        return self.f / (2.0 - self.f)

    def prime_vertical(self, latitude: Column) -> Column:
        s = F.sin(latitude)
        return self.a / F.sqrt(1.0 - self.e2 * s * s)

    def meridian(self, latitude: Column) -> Column:
        s = F.sin(latitude)
        w = 1.0 - self.e2 * s * s
        return self.a * (1.0 - self.e2) / (w * F.sqrt(w))

    def mean_radius(self, latitude: Column) -> Column:
        return F.sqrt(self.prime_vertical(latitude) * self.meridian(latitude))


#: The GRS 80 and WGS 84 ellipsoids.
GRS80 = Ellipsoid(6378137.0, 1.0 / 298.257222101)
WGS84 = Ellipsoid(6378137.0, 1.0 / 298.257223563)


def geodetic_to_cartesian(latitude: Column, longitude: Column, height: Column, ellipsoid: Ellipsoid = GRS80) -> tuple[Column, Column, Column]:
    n = ellipsoid.prime_vertical(latitude)
    level = (n + height) * F.cos(latitude)
    return level * F.cos(longitude), level * F.sin(longitude), (n * (1.0 - ellipsoid.e2) + height) * F.sin(latitude)


def geodetic_to_cartesian_jacobian(latitude: Column, longitude: Column, height: Column, ellipsoid: Ellipsoid = GRS80) -> list[list[Column]]:
    """Rows X, Y, Z; columns latitude (meridian radius), longitude (prime vertical) and height."""
    m, n = ellipsoid.meridian(latitude) + height, ellipsoid.prime_vertical(latitude) + height
    sp, cp, sl, cl = F.sin(latitude), F.cos(latitude), F.sin(longitude), F.cos(longitude)
    return [[-m * sp * cl, -n * cp * sl, cp * cl], [-m * sp * sl, n * cp * cl, cp * sl], [m * cp, F.lit(0.0), sp]]


def geodetic_covariance(latitude: Column, longitude: Column, height: Column, covariance: list[list[Column]], ellipsoid: Ellipsoid = GRS80) -> list[list[Column]]:
    """The geocentric covariance of a position whose latitude, longitude and height have this one."""
    return transform(geodetic_to_cartesian_jacobian(latitude, longitude, height, ellipsoid), covariance)


def cartesian_covariance(latitude: Column, longitude: Column, height: Column, covariance: list[list[Column]], ellipsoid: Ellipsoid = GRS80) -> list[list[Column]]:
    """The covariance of latitude, longitude and height of a position whose geocentric coordinates have this one: the jacobian's columns are
    orthogonal, so its inverse is its transpose with each row over the square of its length."""
    j = geodetic_to_cartesian_jacobian(latitude, longitude, height, ellipsoid)
    length2 = ((ellipsoid.meridian(latitude) + height) ** 2, ((ellipsoid.prime_vertical(latitude) + height) * F.cos(latitude)) ** 2, F.lit(1.0))
    return transform([[j[i][k] / length2[k] for i in range(3)] for k in range(3)], covariance)


def with_geodetic(rows: DataFrame, x: str, y: str, z: str, ellipsoid: Ellipsoid = GRS80, rounds: int = 3) -> DataFrame:
    """Adds latitude, longitude and height. Bowring's parametric latitude is improved by a fixed number of rounds, which for heights on
    and near Earth is below the precision of a double; on the polar axis the longitude is 0. Each round is a column of its own: a
    round uses the one before several times, and as one expression it would double with every round."""
    a, e2 = ellipsoid.a, ellipsoid.e2
    b = a * (1.0 - ellipsoid.f)
    second = e2 / (1.0 - e2)
    out = rows.withColumn("_p", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    out = out.withColumn("_beta", F.when(F.col("_p") > 0, F.atan(F.col(z) * a / (F.col("_p") * b))).otherwise(F.signum(F.col(z)) * (math.pi / 2)))
    for _ in range(rounds):
        out = out.withColumn("latitude", F.atan2(F.col(z) + second * b * F.pow(F.sin("_beta"), 3.0), F.col("_p") - e2 * a * F.pow(F.cos("_beta"), 3.0)))
        out = out.withColumn("_beta", F.atan2((1.0 - ellipsoid.f) * F.sin("latitude"), F.cos("latitude")))
    latitude = F.col("latitude")
    n = ellipsoid.prime_vertical(latitude)
    height = F.col("_p") * F.cos(latitude) + F.col(z) * F.sin(latitude) - n * (1.0 - e2 * F.sin(latitude) * F.sin(latitude))
    return out.withColumns({"longitude": F.when(F.col("_p") > 0, F.atan2(F.col(y), F.col(x))).otherwise(0.0), "height": height}).drop("_p", "_beta")


def enu_rotation(latitude: Column, longitude: Column) -> list[list[Column]]:
    sp, cp, sl, cl = F.sin(latitude), F.cos(latitude), F.sin(longitude), F.cos(longitude)
    return [[-sl, cl, F.lit(0.0)], [-sp * cl, -sp * sl, cp], [cp * cl, cp * sl, sp]]


def _apply(matrix: list[list[Column]], vector: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(sum((m * v for m, v in zip(row[1:], vector[1:], strict=True)), row[0] * vector[0]) for row in matrix)


def ecef_to_enu(dx: Column, dy: Column, dz: Column, latitude: Column, longitude: Column) -> tuple[Column, ...]:
    return _apply(enu_rotation(latitude, longitude), (dx, dy, dz))


def enu_to_ecef(e: Column, n: Column, u: Column, latitude: Column, longitude: Column) -> tuple[Column, ...]:
    r = enu_rotation(latitude, longitude)
    return _apply([list(c) for c in zip(*r, strict=True)], (e, n, u))


@dataclass(frozen=True)
class Helmert:
    """Fourteen parameters of the position-vector convention: translations in metres, rotations in radians, scale as a
    difference from one, each with a yearly rate, at a reference epoch in decimal years."""

    t: tuple[float, float, float]
    r: tuple[float, float, float] = (0.0, 0.0, 0.0)
    d: float = 0.0
    t_rate: tuple[float, float, float] = (0.0, 0.0, 0.0)
    r_rate: tuple[float, float, float] = (0.0, 0.0, 0.0)
    d_rate: float = 0.0
    epoch: float = 2000.0

    def _at(self, epoch: Column | float):
        dt = (epoch if isinstance(epoch, Column) else F.lit(float(epoch))) - self.epoch
        t = [F.lit(a) + b * dt for a, b in zip(self.t, self.t_rate, strict=True)]
        rx, ry, rz = (F.lit(a) + b * dt for a, b in zip(self.r, self.r_rate, strict=True))
        k = 1.0 + F.lit(self.d) + self.d_rate * dt
        return t, [[k, -rz, ry], [rz, k, -rx], [-ry, rx, k]]

    def apply(self, x: Column, y: Column, z: Column, epoch: Column | float) -> tuple[Column, ...]:
        t, m = self._at(epoch)
        return tuple(a + b for a, b in zip(t, _apply(m, (x, y, z)), strict=True))

    def invert(self, x: Column, y: Column, z: Column, epoch: Column | float) -> tuple[Column, ...]:
        """Exact: solves the 3 x 3 system by cofactors."""
        t, m = self._at(epoch)
        v = (x - t[0], y - t[1], z - t[2])
        c = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
        det = m[0][0] * c[0][0] + m[0][1] * c[0][1] + m[0][2] * c[0][2]
        return tuple((c[0][j] * v[0] + c[1][j] * v[1] + c[2][j] * v[2]) / det for j in range(3))


    def apply_vector(self, dx: Column, dy: Column, dz: Column, epoch: Column | float) -> tuple[Column, ...]:
        """A difference of positions in the other frame: turned and scaled, not moved."""
        return _apply(self._at(epoch)[1], (dx, dy, dz))


def move_to_epoch(position: tuple[Column, ...], velocity: tuple[Column, ...], from_epoch: Column, to_epoch: Column) -> tuple[Column, ...]:
    return tuple(p + v * (to_epoch - from_epoch) for p, v in zip(position, velocity, strict=True))


@dataclass(frozen=True)
class TransverseMercator:
    central_meridian: float
    scale: float = 0.9996
    false_easting: float = 500000.0
    false_northing: float = 0.0
    ellipsoid: Ellipsoid = GRS80

    @property
    def _radius(self) -> float:
        n = self.ellipsoid.n
        return self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def _series(self) -> tuple[list[float], list[float]]:
        """Krueger's coefficients to the fourth power of n: forward and inverse."""
        n = self.ellipsoid.n
        forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return forward, inverse

    def forward(self, latitude: Column, longitude: Column) -> tuple[Column, Column]:
        """Easting, northing; null beyond ten degrees from the central meridian."""
        e = math.sqrt(self.ellipsoid.e2)
        dl = longitude - self.central_meridian
        s = F.sin(latitude)
        # conformal latitude's tangent by inverse hyperbolic tangents
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1.0 + t * t))
        north, east = xi, eta
        for j, c in enumerate(self._series()[0], 1):
            north = north + c * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
            east = east + c * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        near = F.abs(dl) <= math.radians(10.0)
        k = self.scale * self._radius
        return F.when(near, self.false_easting + k * east), F.when(near, self.false_northing + k * north)

    def inverse(self, easting: Column, northing: Column, rounds: int = 4) -> tuple[Column, Column]:
        k, e = self.scale * self._radius, math.sqrt(self.ellipsoid.e2)
        xi, eta = (northing - self.false_northing) / k, (easting - self.false_easting) / k
        x, y = xi, eta
        for j, c in enumerate(self._series()[1], 1):
            x = x - c * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
            y = y - c * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        psi = F.atanh(F.sin(x) / F.cosh(y))  # isometric latitude
        s = F.tanh(psi)
        for _ in range(rounds):
            s = F.tanh(psi + e * F.atanh(e * s))
        return F.asin(s), self.central_meridian + F.atan2(F.sinh(y), F.cos(x))

    def point_scale(self, latitude: Column, longitude: Column, step: float = 1e-8) -> Column:
        """By a central difference along the parallel."""
        e1, n1 = self.forward(latitude, longitude - step)
        e2, n2 = self.forward(latitude, longitude + step)
        return F.hypot(e2 - e1, n2 - n1) / (2.0 * step * self.ellipsoid.prime_vertical(latitude) * F.cos(latitude))


def utm_zone(longitude: Column) -> Column:
    """1 to 60, from radians."""
    degrees = F.pmod(F.degrees(longitude) + 180.0, F.lit(360.0))
    return (F.floor(degrees / 6.0) + 1).cast("int")
