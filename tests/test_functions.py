"""Scalar functions and distributions against published and closed values."""

import math

import pytest
from pyspark.sql import functions as F

from meridian.functions import angles, distributions, geodesy, tides, uncertainty, units
from meridian.functions.uncertainty import Q


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize(
    ("text", "degrees"),
    [("12-30-00", 12.5), ("-12 30 00", -12.5), ("12°30'00\"", 12.5), ("12:30:00 s", -12.5), ("100 gon", 90.0), ("200g", 180.0), ("3.5 deg", 3.5), ("45", 45.0), ("1.5rad", math.degrees(1.5)), ("12-61-00", None), ("x", None), ("", None)],
)
def test_parse_angle(spark, text, degrees):
    got = one(spark, angles.parse_angle(F.lit(text))).c0
    assert got is None if degrees is None else got == pytest.approx(math.radians(degrees), abs=1e-12)


def test_dms_carries(spark):
    value = math.radians(10 + 59 / 60 + 59.99999 / 3600)
    r = one(spark, angles.format_dms(F.lit(value), 2), angles.format_dms(F.lit(-value), 0), angles.radians_to_packed(F.lit(value), 2))
    assert (r.c0, r.c1, r.c2) == ("11-00-00.00", "-11-00-00", 11.0)


def test_wraps(spark):
    r = one(spark, angles.wrap_to_2pi(F.lit(-1e-20)), angles.wrap_to_pi(F.lit(math.pi)), angles.wrap_to_pi(F.lit(-math.pi)))
    assert r.c0 == 0.0 and r.c1 == pytest.approx(math.pi) and r.c2 == pytest.approx(math.pi)


def test_circular_mean_of_opposites_is_null(spark):
    rows = spark.createDataFrame([(0.0,), (math.pi,)], "a double")
    assert rows.agg(angles.circular_mean("a").alias("m")).first().m is None


def test_shared_covariance_is_refused():
    with pytest.raises(ValueError):
        Q.of(1.0, 1.0, "c") + Q.of(2.0, 1.0, "c")


def test_propagation_against_differences(spark):
    h = 1e-6
    cases = [(uncertainty.exp, math.exp), (uncertainty.log, math.log), (uncertainty.tan, math.tan), (uncertainty.asin, math.asin), (uncertainty.acos, math.acos), (uncertainty.atan, math.atan), (uncertainty.sqrt, math.sqrt)]
    for fn, plain in cases:
        r = one(spark, fn(Q.of(0.4, 0.01)).variance)
        assert r.c0 == pytest.approx(((plain(0.4 + h) - plain(0.4 - h)) / (2 * h)) ** 2 * 0.01, rel=1e-6)


def test_distributions():
    assert distributions.normal_quantile(0.975) == pytest.approx(1.959963984540054, rel=1e-12)
    assert distributions.chi2_quantile(0.95, 10) == pytest.approx(18.307038053275146, rel=1e-10)
    assert distributions.f_quantile(0.95, 3, 20) == pytest.approx(3.098391224, rel=1e-8)
    assert distributions.t_quantile(0.975, 5) == pytest.approx(2.570581835636314, rel=1e-10)
    assert distributions.non_centrality() == pytest.approx(4.1321, abs=1e-3)
    assert distributions.chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2), rel=1e-12)


def test_conversions(spark):
    with pytest.raises(ValueError):
        units.convert(F.lit(1.0), "metre", "degree")
    r = one(spark, units.convert(F.lit(200.0), "gon", "degree"), units.celsius_to_kelvin(F.lit(-300.0)), units.celsius_to_kelvin(F.lit(0.0)))
    assert r.c0 == pytest.approx(180.0) and r.c1 is None and r.c2 == 273.15


def test_polar_axis(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 6356752.314140356 + 10.0), (0.0, 0.0, -6356752.314140356)], "x double, y double, z double")
    a, b = geodesy.with_geodetic(rows, "x", "y", "z").orderBy("latitude").collect()
    assert b.latitude == pytest.approx(math.pi / 2) and b.longitude == 0.0 and b.height == pytest.approx(10.0, abs=1e-6) and a.height == pytest.approx(0.0, abs=1e-6)


def test_transverse_mercator(spark):
    tm = geodesy.TransverseMercator(math.radians(9.0), ellipsoid=geodesy.WGS84)
    e, n = tm.forward(F.lit(math.radians(48.0)), F.lit(math.radians(11.0)))
    far, _ = tm.forward(F.lit(0.5), F.lit(math.radians(30.0)))
    r = one(spark, e, n, far, tm.point_scale(F.lit(math.radians(48.0)), F.lit(math.radians(9.0))))
    assert r.c0 == pytest.approx(649168.0, abs=60.0) and r.c1 == pytest.approx(5318234.0, abs=400.0) and r.c2 is None and r.c3 == pytest.approx(0.9996, abs=1e-7)


def test_tide_has_the_size_of_the_tide(spark):
    hours = spark.range(24 * 15).select((F.timestamp_seconds(F.lit(946684800) + F.col("id") * 3600)).alias("t"))
    r = hours.select((tides.tidal_correction(F.col("t"), F.lit(0.8), F.lit(0.15), F.lit(100.0)) * 1e8).alias("m")).agg(F.min("m"), F.max("m")).first()
    assert -120 < r[0] < -40 and 80 < r[1] < 220


def test_printed_quantiles():
    """Quantiles as statistical tables print them, and the distribution functions at them."""
    printed = [
        (distributions.normal_quantile(0.975), 1.959964, distributions.normal_cdf, (), 0.975), (distributions.chi2_quantile(0.95, 10), 18.307038, distributions.chi2_cdf, (10,), 0.95), (distributions.t_quantile(0.975, 5), 2.570582, distributions.t_cdf, (5,), 0.975),
        (distributions.f_quantile(0.95, 3, 10), 3.708265, distributions.f_cdf, (3, 10), 0.95), (distributions.chi2_quantile(0.05, 10), 3.940299, distributions.chi2_cdf, (10,), 0.05), (distributions.f_quantile(0.95, 1, 1), 161.447639, distributions.f_cdf, (1, 1), 0.95), (distributions.t_quantile(0.95, 1), 6.313752, distributions.t_cdf, (1,), 0.95),
    ]
    for got, value, cdf, degrees, p in printed:
        assert abs(got - value) < 1e-6 and abs(cdf(got, *degrees) - p) < 1e-9
    assert abs(distributions.non_centrality() - 4.132148) < 1e-6 and abs(distributions.confidence_scale(0.95, 2) - 2.447747) < 1e-6
