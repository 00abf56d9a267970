"""Queries of scalar functions: angles, uncertainty, units, geodesy, tides."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meridian.functions import angles, geodesy, tides, uncertainty, units
from meridian.functions.uncertainty import Q
from meridian.operators import levelling, monitoring, total_station
from meridian.plans.registry import points, query, r, table


def _wrap(x: str) -> str:
    return f"({x} - 2*pi()*floor(({x})/(2*pi())))"


@query("angle_wraps", f"SELECT point, round({_wrap('longitude*3')},9)+0.0 AS two_pi, round(pi()-{_wrap('pi()-longitude*3')},9)+0.0 AS one_pi, round(pi()-{_wrap('pi()-(longitude-latitude)')},9)+0.0 AS difference FROM {{points}}")
def angle_wraps(spark, sf):
    p = points(spark, sf)
    return p.select("point", r(angles.wrap_to_2pi(F.col("longitude") * 3), 9).alias("two_pi"), r(angles.wrap_to_pi(F.col("longitude") * 3), 9).alias("one_pi"), r(angles.angular_difference(F.col("longitude"), F.col("latitude")), 9).alias("difference"))


@query("angle_dms", "WITH t AS (SELECT point, latitude, round(abs(degrees(latitude))*3600, 4) AS s FROM {points}) SELECT point, CASE WHEN latitude < 0 THEN -1 ELSE 1 END AS sign, CAST(floor(s/3600) AS INTEGER) AS degrees, CAST(floor((s-floor(s/3600)*3600)/60) AS INTEGER) AS minutes, round(s-floor(s/3600)*3600-floor((s-floor(s/3600)*3600)/60)*60, 4)+0.0 AS seconds FROM t")
def angle_dms(spark, sf):
    p = points(spark, sf).withColumn("d", angles.radians_to_dms(F.col("latitude"), 4))
    return p.select("point", "d.sign", "d.degrees", "d.minutes", r(F.col("d.seconds"), 4).alias("seconds"))


@query("angle_text", "SELECT point, round(radians((point % 360) + (point % 60)/60.0 + (point % 59)/3600.0), 9) AS dms, round((point % 400) * pi()/200, 9) AS gon, round(radians(point % 360), 9) AS bare FROM {points}")
def angle_text(spark, sf):
    p = points(spark, sf)
    n = lambda m: (F.col("point") % m).cast("string")
    dms = F.concat(n(360), F.lit("-"), n(60), F.lit("-"), n(59))
    return p.select("point", r(angles.parse_angle(dms), 9).alias("dms"), r(angles.parse_angle(F.concat(n(400), F.lit(" gon"))), 9).alias("gon"), r(angles.parse_angle(n(360)), 9).alias("bare"))


@query("angle_packed", "SELECT point, round(radians((point % 360) + (point % 60)/60.0 + (point % 59)/3600.0), 9) AS radians FROM {points}")
def angle_packed(spark, sf):
    c = F.col("point")
    return points(spark, sf).select("point", r(angles.packed_to_radians((c % 360) + (c % 60) / 100.0 + (c % 59) / 10000.0), 9).alias("radians"))


@query("circular_mean", f"WITH s AS (SELECT point % 50 AS grp, sum(sin(longitude/6+latitude)) AS s, sum(cos(longitude/6+latitude)) AS c FROM {{points}} GROUP BY 1) SELECT grp, round({_wrap('atan2(s,c)')}, 6)+0.0 AS mean FROM s")
def circular_mean(spark, sf):
    return points(spark, sf).groupBy((F.col("point") % 50).alias("grp")).agg(r(angles.circular_mean(F.col("longitude") / 6 + F.col("latitude"))).alias("mean"))


@query("uncertainty_algebra", """
SELECT point, round(a+b,6)+0.0 AS total, round(va+vb,9)+0.0 AS total_variance, round(a*b,8)+0.0 AS product, round(b*b*va+a*a*vb,8)+0.0 AS product_variance,
round(a/b,6)+0.0 AS ratio, round(va/(b*b)+a*a*vb/(b*b*b*b),9)+0.0 AS ratio_variance, round(sin(a),9)+0.0 AS sine, round(cos(a)*cos(a)*va,9)+0.0 AS sine_variance,
round(atan2(a,b),9)+0.0 AS angle, round((b*b*va+a*a*vb)/((a*a+b*b)*(a*a+b*b)),9)+0.0 AS angle_variance, round(sqrt(a*a+b*b),6)+0.0 AS length, round((a*a*va+b*b*vb)/(a*a+b*b),9)+0.0 AS length_variance,
round(sqrt(b),6)+0.0 AS root, round(vb/(4*b),9)+0.0 AS root_variance
FROM (SELECT point, longitude AS a, 2.0+latitude AS b, 0.01 AS va, 0.02 AS vb FROM {points})""")
def uncertainty_algebra(spark, sf):
    a, b = Q.of("longitude", 0.01), Q.of(2.0 + F.col("latitude"), 0.02)
    out = [("total", a + b, 6, 9), ("product", a * b, 8, 8), ("ratio", a / b, 6, 9), ("sine", uncertainty.sin(a), 9, 9), ("angle", uncertainty.atan2(a, b), 9, 9), ("length", uncertainty.hypot(a, b), 6, 9), ("root", uncertainty.sqrt(b), 6, 9)]
    return points(spark, sf).select("point", *(c for n, q, d, e in out for c in (r(q.value, d).alias(n), r(q.variance, e).alias(f"{n}_variance"))))


@query("units_and_epochs", """
SELECT o_orderkey, round(o_totalprice*0.3048,4)+0.0 AS metres, round(year(o_orderdate)+(epoch_us(o_orderdate)-epoch_us(make_timestamp(year(o_orderdate),1,1,0,0,0.0)))/CAST(epoch_us(make_timestamp(year(o_orderdate)+1,1,1,0,0,0.0))-epoch_us(make_timestamp(year(o_orderdate),1,1,0,0,0.0)) AS DOUBLE),6)+0.0 AS year,
CAST(floor((CAST(o_orderdate AS DATE)-DATE '1980-01-06')/7.0) AS INTEGER) AS week, CAST((CAST(o_orderdate AS DATE)-DATE '1980-01-06')%7 AS INTEGER) AS day FROM orders""")
def units_and_epochs(spark, sf):
    week = units.gps_week(F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", r(units.convert(F.col("o_totalprice"), "foot", "metre"), 4).alias("metres"), r(units.decimal_year(F.col("o_orderdate"))).alias("year"), week.week.alias("week"), week.day.alias("day"))


@query("printed_sigma", "SELECT p_partkey, round(0.5*pow(10.0,-(p_partkey % 4))/sqrt(3.0),9) AS sigma FROM part")
def printed_sigma(spark, sf):
    text = F.when(F.col("p_partkey") % 4 == 0, F.lit("12")).otherwise(F.concat(F.lit("12."), F.repeat(F.lit("0"), (F.col("p_partkey") % 4).cast("int"))))
    return table(spark, sf, "part").select("p_partkey", r(units.printed_sigma(text), 9).alias("sigma"))


E2, A = repr(geodesy.GRS80.e2), "6378137.0"
_N = f"({A}/sqrt(1-{E2}*sin(latitude)*sin(latitude)))"


@query("geodetic_to_cartesian", f"SELECT point, round(({_N}+height)*cos(latitude)*cos(longitude),4)+0.0 AS x, round(({_N}+height)*cos(latitude)*sin(longitude),4)+0.0 AS y, round(({_N}*(1-{E2})+height)*sin(latitude),4)+0.0 AS z FROM {{points}}")
def geodetic_to_cartesian(spark, sf):
    x, y, z = geodesy.geodetic_to_cartesian(F.col("latitude"), F.col("longitude"), F.col("height"))
    return points(spark, sf).select("point", r(x, 4).alias("x"), r(y, 4).alias("y"), r(z, 4).alias("z"))


@query("cartesian_round_trip", "SELECT point, round(latitude,8)+0.0 AS latitude, round(longitude,8)+0.0 AS longitude, round(height,3)+0.0 AS height FROM {points}")
def cartesian_round_trip(spark, sf):
    x, y, z = geodesy.geodetic_to_cartesian(F.col("latitude"), F.col("longitude"), F.col("height"))
    p = points(spark, sf).select("point", x.alias("x"), y.alias("y"), z.alias("z"))
    out = geodesy.with_geodetic(p, "x", "y", "z")
    return out.select("point", r(F.col("latitude"), 8).alias("latitude"), r(F.col("longitude"), 8).alias("longitude"), r(F.col("height"), 3).alias("height"))


@query("local_horizon", "SELECT point, round(-sin(longitude)*10+cos(longitude)*20,6)+0.0 AS east, round(-sin(latitude)*cos(longitude)*10-sin(latitude)*sin(longitude)*20+cos(latitude)*30,6)+0.0 AS north, round(cos(latitude)*cos(longitude)*10+cos(latitude)*sin(longitude)*20+sin(latitude)*30,6)+0.0 AS up FROM {points}")
def local_horizon(spark, sf):
    e, n, u = geodesy.ecef_to_enu(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.col("latitude"), F.col("longitude"))
    return points(spark, sf).select("point", r(e).alias("east"), r(n).alias("north"), r(u).alias("up"))


@query("helmert_round_trip", "SELECT point, round(longitude*1e6,3)+0.0 AS x, round(latitude*1e6,3)+0.0 AS y, round(height*1e3,3)+0.0 AS z FROM {points}")
def helmert_round_trip(spark, sf):
    h = geodesy.Helmert((0.07, 0.03, -0.07), (1e-8, -2e-8, 3e-8), 2e-9, (0.001, 0.0, 0.002), (1e-10, 0.0, -1e-10), 1e-10, 2010.0)
    p = points(spark, sf).select("point", (F.col("longitude") * 1e6).alias("x"), (F.col("latitude") * 1e6).alias("y"), (F.col("height") * 1e3).alias("z"))
    there = h.apply(F.col("x"), F.col("y"), F.col("z"), 2020.5)
    p = p.select("point", *(c.alias(n) for c, n in zip(there, "xyz", strict=True)))
    back = h.invert(F.col("x"), F.col("y"), F.col("z"), 2020.5)
    return p.select("point", *(r(c, 3).alias(n) for c, n in zip(back, "xyz", strict=True)))


@query("helmert_apply", "SELECT point, round(0.08+1.000000003*x-2.9e-8*y-2e-8*z,4)+0.0 AS x, round(0.03+2.9e-8*x+1.000000003*y-1.1e-8*z,4)+0.0 AS y, round(-0.05+2e-8*x+1.1e-8*y+1.000000003*z,4)+0.0 AS z FROM (SELECT point, longitude*1e6 AS x, latitude*1e6 AS y, height*1e3 AS z FROM {points})")
def helmert_apply(spark, sf):
    h = geodesy.Helmert((0.07, 0.03, -0.07), (1e-8, -2e-8, 3e-8), 2e-9, (0.001, 0.0, 0.002), (1e-10, 0.0, -1e-10), 1e-10, 2010.0)
    out = h.apply(F.col("longitude") * 1e6, F.col("latitude") * 1e6, F.col("height") * 1e3, 2020.0)
    return points(spark, sf).select("point", *(r(c, 4).alias(n) for c, n in zip(out, "xyz", strict=True)))


@query("transverse_mercator_round_trip", "SELECT point, round(latitude,8)+0.0 AS latitude, round(longitude/50,8)+0.0 AS longitude FROM {points}")
def transverse_mercator_round_trip(spark, sf):
    tm = geodesy.TransverseMercator(0.0)
    e, n = tm.forward(F.col("latitude"), F.col("longitude") / 50)
    p = points(spark, sf).select("point", e.alias("e"), n.alias("n"))
    lat, lon = tm.inverse(F.col("e"), F.col("n"))
    return p.select("point", r(lat, 8).alias("latitude"), r(lon, 8).alias("longitude"))


@query("utm_zone", "SELECT point, CAST(floor((degrees(longitude)+180 - 360*floor((degrees(longitude)+180)/360))/6)+1 AS INTEGER) AS zone FROM {points}")
def utm_zone(spark, sf):
    return points(spark, sf).select("point", geodesy.utm_zone(F.col("longitude")).alias("zone"))


@query("atmosphere", "SELECT point, round((((287.6155e0+4.8866e0/(0.85e0*0.85e0)+0.068e0/pow(0.85e0, 4))*273.15e0/101325)*(100000+height)/t - 0.1127*0.6*611.2*exp(17.62*(t-273.15)/(243.12+t-273.15))/t),6)+0.0 AS refractivity FROM (SELECT point, height, 283.15+10*latitude AS t FROM {points})")
def atmosphere(spark, sf):
    n = total_station.refractive_index(283.15 + 10 * F.col("latitude"), 100000 + F.col("height"), F.lit(0.6), 0.85)
    return points(spark, sf).select("point", r((n - 1.0) * 1e6, 6).alias("refractivity"))


@query("sight_reduction", "SELECT point, round(d*sin(z),6)+0.0 AS horizontal, round(sin(z)*sin(z)*4e-6+d*d*cos(z)*cos(z)*1e-10,12)+0.0 AS horizontal_variance, round(d*cos(z)+1.5-1.7,6)+0.0 AS height_difference, round(cos(z)*cos(z)*4e-6+d*d*sin(z)*sin(z)*1e-10+2e-6,12)+0.0 AS height_difference_variance, round(0.87*(d*sin(z))*(d*sin(z))/(2*6371000.0),9)+0.0 AS refraction, round(d*sin(z)*6371000.0/(6371000.0+height),6)+0.0 AS ellipsoid FROM (SELECT point, height, 100.0+height/10 AS d, 1.5+latitude/10 AS z FROM {points})")
def sight_reduction(spark, sf):
    p = points(spark, sf).withColumns({"d": 100.0 + F.col("height") / 10, "z": 1.5 + F.col("latitude") / 10})
    out = total_station.reduce_basic(Q.of("d", 4e-6), Q.of("z", 1e-10), Q.of(1.5, 1e-6), Q.of(1.7, 1e-6))
    flat = out["horizontal"].value
    return p.select("point", r(flat).alias("horizontal"), r(out["horizontal"].variance, 12).alias("horizontal_variance"), r(out["height_difference"].value).alias("height_difference"), r(out["height_difference"].variance, 12).alias("height_difference_variance"), r(total_station.curvature_and_refraction(flat), 9).alias("refraction"), r(total_station.to_ellipsoid(flat, F.col("height"))).alias("ellipsoid"))


@query("orthometric_correction", "SELECT point, round(-0.0053024*sin(2*(latitude+0.0005))*height*0.001,9)+0.0 AS correction FROM {points}")
def orthometric_correction(spark, sf):
    c = levelling.orthometric_correction(F.col("latitude"), F.col("latitude") + 0.001, F.col("height"), F.col("height"))
    return points(spark, sf).select("point", r(c, 9).alias("correction"))


@query("error_ellipse", "SELECT point, round(sqrt(m+h),9)+0.0 AS semi_major, round(sqrt(greatest(m-h,0)),9)+0.0 AS semi_minor FROM (SELECT point, (xx+yy)/2 AS m, sqrt((yy-xx)*(yy-xx)/4+xy*xy) AS h FROM (SELECT point, 1.0+latitude*latitude AS xx, 2.0+latitude AS yy, 0.3*latitude AS xy FROM {points}))")
def error_ellipse(spark, sf):
    from meridian.operators.adjustment import ellipse

    lat = F.col("latitude")
    e = ellipse(1.0 + lat * lat, 0.3 * lat, 2.0 + lat)
    return points(spark, sf).select("point", r(e["semi_major"], 9).alias("semi_major"), r(e["semi_minor"], 9).alias("semi_minor"))


@query("nice_factor", "SELECT point, CASE WHEN v < 1 THEN 1.0 ELSE pow(10.0,floor(log10(v)))*(CASE WHEN v/pow(10.0,floor(log10(v))) >= 5 THEN 5.0 WHEN v/pow(10.0,floor(log10(v))) >= 2 THEN 2.0 ELSE 1.0 END) END AS factor FROM (SELECT point, abs(height)+0.5 AS v FROM {points})")
def nice_factor(spark, sf):
    return points(spark, sf).select("point", monitoring.nice_factor(F.abs("height") + 0.5).alias("factor"))


def _tide_sql() -> str:
    """The same closed formulas as nested selects."""
    e = {k: tides.ELEMENTS[k] for k in tides.ELEMENTS}
    sec = math.pi / 648000.0

    def el(k: str) -> str:
        (a, b, c, d), turns = e[k]
        return f"({a * sec!r} + t*(({turns * 2 * math.pi + b * sec!r}) + t*({c * sec!r} + t*({d * sec!r}))))"

    i, w = math.radians(5 + 8 / 60 + 43.3546 / 3600), math.radians(23 + 27 / 60 + 8.26 / 3600)
    m, q = tides.MOTION_RATIO, tides.ECCENTRICITY
    t0 = "SELECT event_id, (epoch_us(ts)/1e6 + 2209032000.0)/(36525.0*86400.0) AS t, (epoch_us(ts)/1e6 - 86400.0*floor(epoch_us(ts)/1e6/86400.0))/3600.0 AS hours, (user_id % 60)/100.0 AS lat, (user_id % 30)/10.0 AS lon, 100.0 AS hgt FROM events"
    t1 = f"SELECT *, {el('moon')} AS s, {el('perigee')} AS p, {el('sun')} AS h, {el('node')} AS n, {el('sun_perigee')} AS p1, 0.01675104 - t*(0.00004180 + t*0.000000126) AS e1 FROM ({t0})"
    t2 = f"SELECT *, acos({math.cos(i) * math.cos(w)!r} - {math.sin(i) * math.sin(w)!r}*cos(n)) AS tilt FROM ({t1})"
    t3 = f"SELECT *, asin({math.sin(i)!r}*sin(n)/sin(tilt)) AS nu FROM ({t2})"
    t4 = f"SELECT *, atan2({math.sin(w)!r}*sin(n)/sin(tilt), cos(n)*cos(nu)+sin(n)*sin(nu)*{math.cos(w)!r}) AS alpha, (hours-12.0)*{math.pi / 12!r}+lon+h AS mer FROM ({t3})"
    t5 = f"SELECT *, s-(n-alpha)+2*{q}*sin(s-p)+1.25*{q * q!r}*sin(2*(s-p))+3.75*{m * q!r}*sin(s-2*h+p)+1.375*{m * m!r}*sin(2*(s-h)) AS orb, h+2*e1*sin(h-p1) AS sol FROM ({t4})"
    cosz = lambda tilt, orb, ra: f"(sin(lat)*sin({tilt})*sin({orb})+cos(lat)*(pow(cos({tilt}/2),2)*cos({orb}-({ra}))+pow(sin({tilt}/2),2)*cos({orb}+({ra}))))"
    t6 = f"SELECT *, {cosz('tilt', 'orb', 'mer-nu')} AS cm, {cosz(repr(w), 'sol', 'mer')} AS cs, {tides.EQUATOR}*sqrt(1/(1+0.006738*pow(sin(lat),2)))+hgt AS r FROM ({t5})"
    am = 1.0 / (tides.MOON_DISTANCE * (1 - q * q))
    t7 = f"SELECT *, {1 / tides.MOON_DISTANCE!r}+{am!r}*({q}*cos(s-p)+{q * q!r}*cos(2*(s-p))+1.875*{m * q!r}*cos(s-2*h+p)+{m * m!r}*cos(2*(s-h))) AS im, {1 / tides.SUN_DISTANCE!r}+e1*cos(h-p1)/({tides.SUN_DISTANCE}*(1-e1*e1)) AS iss FROM ({t6})"
    return f"SELECT event_id, round(1e8*1.16*({tides.GRAVITATION * tides.MOON_MASS!r}*(r*pow(im,3)*(3*cm*cm-1)+1.5*r*r*pow(im,4)*(5*pow(cm,3)-3*cm))+{tides.GRAVITATION * tides.SUN_MASS!r}*r*pow(iss,3)*(3*cs*cs-1)),4)+0.0 AS microgal FROM ({t7})"


@query("earth_tide", _tide_sql())
def earth_tide(spark, sf):
    u = F.col("user_id")
    t = tides.tidal_correction(F.col("ts"), u % 60 / 100.0, u % 30 / 10.0, F.lit(100.0))
    return table(spark, sf, "events").select("event_id", r(t * 1e8, 4).alias("microgal"))
