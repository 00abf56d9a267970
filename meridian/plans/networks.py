"""Queries of network builders, matrices and solutions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meridian.operators import adjustment, builders, geoid, gravimetry, levelling, matrices, solutions
from meridian.plans.registry import SQL, VIEWS, points, query, r, readings, table
from meridian.plans.surveys import LINES, ORDER, VISITS, BASELINES, _baselines, _lines

#: Normal quantiles of 0.9995 and 0.80, as printed in tables.
Z9995, Z80 = 3.2905267314918945, 0.8416212335729143


def solved_sql(rows: str, held: str, last: str) -> str:
    """SQL that adjusts differences: `rows` selects (obs, a, b, l, w) with l = b - a; the station `held` has height 0. The normal equations
    are eliminated row by row, with the unit matrix beside them, so that `last` can use heights x(name, z), cofactors q(a, b, q) and rows o."""
    return f"""
WITH RECURSIVE o AS ({rows}), s AS (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT a AS name FROM o UNION SELECT b FROM o) WHERE name <> '{held}'), c AS (SELECT count(*) AS n FROM s),
t AS (SELECT obs, k, w, l, 1.0 AS f FROM o JOIN s ON b = name UNION ALL SELECT obs, k, w, l, -1.0 FROM o JOIN s ON a = name),
e AS (SELECT p.k AS i, q.k AS j, sum(p.w*p.f*q.f) AS v FROM t p JOIN t q ON p.obs = q.obs GROUP BY ALL UNION ALL SELECT k, n+1, sum(w*f*l) FROM t, c GROUP BY ALL UNION ALL SELECT k, n+1+k, 1.0 FROM s, c),
r AS (SELECT i, list(coalesce(v, 0.0) ORDER BY j) AS row FROM (SELECT k AS i, unnest(generate_series(1, 2*n+1)) AS j FROM s, c) LEFT JOIN e USING (i, j) GROUP BY i),
g AS (SELECT CAST(1 AS BIGINT) AS k, (SELECT list(row ORDER BY i) FROM r) AS m UNION ALL SELECT k+1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / m[k][k]) ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END) FROM g, c WHERE k <= n),
d AS (SELECT m FROM g, c WHERE k = n+1), x AS (SELECT name, m[k][n+1] AS z FROM s, d, c UNION ALL SELECT '{held}', 0.0), q AS (SELECT s.name AS a, u.name AS b, m[s.k][n+1+u.k] AS q FROM s, s AS u, d, c),
v AS (SELECT o.*, y.z - p.z - l AS v, coalesce(qa.q, 0) + coalesce(qb.q, 0) - 2*coalesce(qab.q, 0) AS spread FROM o JOIN x p ON o.a = p.name JOIN x y ON o.b = y.name LEFT JOIN q qa ON qa.a = o.a AND qa.b = o.a LEFT JOIN q qb ON qb.a = o.b AND qb.b = o.b LEFT JOIN q qab ON qab.a = o.a AND qab.b = o.b),
y AS (SELECT sum(w*v*v) AS vpv, count(*) - (SELECT n FROM c) AS dof FROM v)
{last}"""


EDGE_ROWS = "SELECT a || '-' || b AS obs, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, difference AS l, n/1e6 AS w FROM {edges}"


def _height_network(spark, sf):
    from meridian.plans.estimation import _height_network as own

    return own(spark, sf)


def _adjusted(spark, sf):
    stations, observations = _height_network(spark, sf)
    return stations, observations, adjustment.adjust(stations, observations, "height_1d")


@query("observation_tests", solved_sql(EDGE_ROWS, "0", f"SELECT obs, round(v,6)+0.0 AS residual, round(1-w*spread,6)+0.0 AS redundancy, round(abs(v)*sqrt(w/(1-w*spread)),5)+0.0 AS w, CASE WHEN abs(v)*sqrt(w/(1-w*spread)) > {Z9995} THEN 'rejected' ELSE 'accepted' END AS decision, round({Z9995 + Z80}/sqrt(w*(1-w*spread)),4)+0.0 AS minimal_detectable_bias FROM v"))
def observation_tests(spark, sf):
    """Data snooping with known sigmas, and the bias each test can detect."""
    _, _, out = _adjusted(spark, sf)
    t = adjustment.reliability(adjustment.data_snooping(out["residuals"], out["statistics"]))
    return t.select("obs", r(F.col("residual")).alias("residual"), r(F.col("redundancy")).alias("redundancy"), r(F.col("w"), 5).alias("w"), "decision", r(F.col("minimal_detectable_bias"), 4).alias("minimal_detectable_bias"))


@query("external_reliability", solved_sql(EDGE_ROWS, "0", f"""
SELECT obs, round(n,9)+0.0 AS influence, round({Z9995 + Z80}/sqrt(w*(1-w*spread)),4)+0.0 AS minimal_detectable_bias, round(n*{Z9995 + Z80}/sqrt(w*(1-w*spread)),4)+0.0 AS external_effect
FROM v JOIN (SELECT v.obs, sqrt(sum(pow(v.w*(coalesce(qb.q,0)-coalesce(qa.q,0)),2))) AS n FROM v CROSS JOIN s LEFT JOIN q qa ON qa.a = s.name AND qa.b = v.a LEFT JOIN q qb ON qb.a = s.name AND qb.b = v.b GROUP BY v.obs) USING (obs)"""))
def external_reliability(spark, sf):
    """What an error of the size that each test can just detect does to all heights."""
    stations, observations = _height_network(spark, sf)
    out = adjustment.adjust(stations, observations, "height_1d", influence=True)
    t = adjustment.reliability(out["residuals"])
    return t.select("obs", r(F.col("influence"), 9).alias("influence"), r(F.col("minimal_detectable_bias"), 4).alias("minimal_detectable_bias"), r(F.col("external_effect"), 4).alias("external_effect"))


@query("statistics_items", solved_sql(EDGE_ROWS, "0", "SELECT item, round(value,5)+0.0 AS value FROM (SELECT unnest(['rows', 'unknowns', 'dof', 'vpv', 'variance_factor', 'rank_defect']) AS item, unnest([CAST((SELECT count(*) FROM o) AS DOUBLE), n, dof, vpv, vpv/dof, 0]) AS value FROM y, c)"))
def statistics_items(spark, sf):
    _, _, out = _adjusted(spark, sf)
    return solutions.statistics_items(out["statistics"].drop("iterations")).select("item", r(F.col("value"), 5).alias("value"))


@query("station_rows", solved_sql(EDGE_ROWS, "0", "SELECT name AS station, round(z,6)+0.0 AS z, round(sqrt(q),6)+0.0 AS sigma_z FROM x LEFT JOIN q ON q.a = name AND q.b = name"))
def station_rows(spark, sf):
    _, _, out = _adjusted(spark, sf)
    return solutions.station_rows(out["stations"], out["cofactors"]).select("station", r(F.col("z")).alias("z"), r(F.col("sigma_z")).alias("sigma_z"))


@query("technique_breakdown", solved_sql(EDGE_ROWS, "0", "SELECT technique, count(*) AS rows, round(sum(1-w*spread),5)+0.0 AS redundancy, round(sum(1-w*spread)/(SELECT sum(1-w*spread) FROM v),6)+0.0 AS share, round(sum(w*v*v),5)+0.0 AS vpv, round(sum(w*v*v)/sum(1-w*spread),6)+0.0 AS variance_factor FROM (SELECT *, CASE WHEN CAST(a AS INTEGER) % 2 = 0 THEN 'level' ELSE 'total station' END AS technique FROM v) GROUP BY technique"))
def technique_breakdown(spark, sf):
    _, observations, out = _adjusted(spark, sf)
    kinds = observations.withColumn("technique", F.when(F.col("at").cast("int") % 2 == 0, "level").otherwise("total station"))
    b = solutions.technique_breakdown(out["residuals"], kinds)
    return b.select("technique", "rows", r(F.col("redundancy"), 5).alias("redundancy"), r(F.col("share")).alias("share"), r(F.col("vpv"), 5).alias("vpv"), r(F.col("variance_factor")).alias("variance_factor"))


@query("residual_features", solved_sql(EDGE_ROWS, "0", "SELECT obs, a AS at, b AS \"to\", round(v,6)+0.0 AS residual FROM v"))
def residual_features(spark, sf):
    _, observations, out = _adjusted(spark, sf)
    return solutions.residual_features(out["residuals"], observations, out["stations"]).select("obs", "at", "to", r(F.col("residual")).alias("residual"))


@query("run_summary", solved_sql(EDGE_ROWS, "0", f"SELECT dof, CAST(sum(CASE WHEN abs(v)*sqrt(w/(1-w*spread)) > {Z9995} THEN 1 ELSE 0 END) AS BIGINT) AS rejected, round(max(abs(v)*sqrt(w/(1-w*spread))),5)+0.0 AS largest_w FROM v, y GROUP BY dof"))
def run_summary(spark, sf):
    _, _, out = _adjusted(spark, sf)
    s = solutions.run_summary(out["statistics"], adjustment.data_snooping(out["residuals"], out["statistics"]))
    return s.select("dof", "rejected", r(F.col("largest_w"), 5).alias("largest_w"))


@query("matching_observations", solved_sql(EDGE_ROWS, "0", f"SELECT obs FROM v WHERE abs(v)*sqrt(w/(1-w*spread)) <= {Z9995} AND contains(obs, '1-2')"))
def matching_observations(spark, sf):
    _, _, out = _adjusted(spark, sf)
    return solutions.matches(adjustment.data_snooping(out["residuals"], out["statistics"]), "accepted", "1-2").select("obs")


SQL["network_adjustment"] = solved_sql(EDGE_ROWS, "0", "SELECT 'n1' AS network_id, name AS station, round(z,6)+0.0 AS height, round(q,6)+0.0 AS cofactor, dof, round(vpv/dof,6)+0.0 AS variance_factor FROM y, x LEFT JOIN q ON q.a = name AND q.b = name").format(edges=f"({VIEWS['edges']})")
SQL["distributed_adjustment"] = solved_sql(EDGE_ROWS, "0", "SELECT name AS station, round(z,4)+0.0 AS height FROM x WHERE name <> '0'").format(edges=f"({VIEWS['edges']})")

LINE_ROWS = f"SELECT CAST(line AS VARCHAR) AS obs, \"from\" AS a, \"to\" AS b, height_difference AS l, 1/variance AS w FROM ({LINES}) WHERE \"from\" <> \"to\""


@query("level_network", solved_sql(LINE_ROWS, "S0", "SELECT name AS station, round(z+100,5)+0.0 AS height, round(1e6*q,6)+0.0 AS cofactor FROM x LEFT JOIN q ON q.a = name AND q.b = name"))
def level_network(spark, sf):
    """Heights out of reduced lines, held at one benchmark."""
    benchmarks = spark.createDataFrame([("S0", 100.0, 0.0)], "station string, height double, variance double")
    stations, observations = builders.level_network(_lines(spark, sf), benchmarks)
    out = adjustment.adjust(stations, observations, "height_1d")
    own = out["cofactors"].where("i = j").select(F.expr("substring_index(i, ':', 1)").alias("station"), (1e6 * F.col("q")).alias("cofactor"))
    return out["stations"].join(own, "station", "left").select("station", r(F.col("z"), 5).alias("height"), r(F.col("cofactor")).alias("cofactor"))


@query("level_and_trigonometric", solved_sql(LINE_ROWS + " UNION ALL SELECT 't' || p_partkey, 'S' || (p_partkey % 7), 'S' || (p_size % 7), p_size/100.0, 1e4 FROM part WHERE p_partkey % 7 <> p_size % 7", "S0", "SELECT name AS station, round(z,5)+0.0 AS height FROM x"))
def level_and_trigonometric(spark, sf):
    """Two techniques' height differences in one network."""
    benchmarks = spark.createDataFrame([("S0", 0.0, 0.0)], "station string, height double, variance double")
    stations, observations = builders.level_network(_lines(spark, sf), benchmarks)
    name = lambda c: F.concat(F.lit("S"), (F.col(c) % 7).cast("string"))
    more = table(spark, sf, "part").where("p_partkey % 7 <> p_size % 7").select(F.lit("levelling").alias("network_id"), F.col("p_partkey").cast("string").alias("obs"), name("p_partkey").alias("at"), name("p_size").alias("to"), (F.col("p_size") / 100.0).alias("value"), F.lit(1e-4).alias("variance"))
    out = adjustment.adjust(stations, builders.add_height_differences(observations, more, "trigonometric"), "height_1d")
    return out["stations"].select("station", r(F.col("z"), 5).alias("height"))


@query("setup_network", "WITH s AS (SELECT l_orderkey AS setup, l_linenumber AS target, max(l_tax)*100 AS imbalance, max(l_quantity) AS height_difference FROM lineitem GROUP BY ALL) SELECT 'setup:' || setup || ':' || target AS obs, round(height_difference,4)+0.0 AS value, round(1e6*(3e-6 + imbalance*imbalance*1e-8),6)+0.0 AS variance, (SELECT count(*) FROM s x WHERE x.setup = s.setup AND x.target > s.target) AS shared FROM s")
def setup_network(spark, sf):
    """One observation a foresight, and how many of its setup's later ones it is correlated with."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("setup"), F.col("l_linenumber").alias("target")).agg((F.max("l_tax") * 100).alias("imbalance"), F.max("l_quantity").alias("height_difference")).withColumns({"backsight_variance": F.lit(1e-6), "foresight_variance": F.lit(2e-6), "from": F.lit("B")})
    benchmarks = spark.createDataFrame([("B", 0.0, 0.0)], "station string, height double, variance double")
    _, rows, shared = builders.setup_network(s, benchmarks, levelling.foresight_covariances(s, 1e-8))
    n = shared.groupBy(F.col("obs_a").alias("obs")).agg(F.count("*").alias("shared"))
    return rows.join(n, "obs", "left").select("obs", r(F.col("value"), 4).alias("value"), r(F.col("variance") * 1e6).alias("variance"), F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


@query("harmonised_benchmarks", "SELECT c_custkey AS station, round(c_acctbal - CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 40 ELSE 0 END,6)+0.0 AS height, round(1e-4 + CASE WHEN c_custkey % 2 = 0 THEN 25e-4 ELSE 0 END,9)+0.0 AS variance FROM customer")
def harmonised_benchmarks(spark, sf):
    k = F.col("c_custkey")
    b = table(spark, sf, "customer").select(k.alias("station"), F.col("c_acctbal").alias("height"), F.lit(1e-4).alias("variance"), F.when(k % 2 == 0, "ellipsoidal").otherwise("orthometric").alias("height_type"), (k % 40).cast("double").alias("undulation"), F.lit(25e-4).alias("undulation_variance"))
    return builders.harmonised(b).select("station", r(F.col("height")).alias("height"), r(F.col("variance"), 9).alias("variance"))


@query("gravity_network", f'SELECT \'visit:\' || session || \':\' || visit AS obs, station AS "at", "to", round(d,6)+0.0 AS value, round(v,9)+0.0 AS variance, CASE WHEN more IS NOT NULL THEN round(-shared,9)+0.0 END AS covariance FROM (SELECT *, lead(station) OVER w AS "to", lead(value) OVER w - value AS d, lead(variance) OVER w + variance AS v, lead(variance) OVER w AS shared, lead(visit, 2) OVER w AS more FROM ({VISITS}) WINDOW w AS (PARTITION BY session ORDER BY visit)) WHERE "to" IS NOT NULL')
def gravity_network(spark, sf):
    """Successive differences with the covariance each has with the next."""
    visits = gravimetry.occupations(readings(spark, sf), ORDER)
    known = spark.createDataFrame([("view", 980.0, 0.0)], "station string, value double, variance double")
    _, rows, shared = builders.gravity_network(visits, known)
    c = shared.select(F.col("obs_a").alias("obs"), "covariance")
    return rows.join(c, "obs", "left").select("obs", "at", "to", r(F.col("value")).alias("value"), r(F.col("variance"), 9).alias("variance"), r(F.col("covariance"), 9).alias("covariance"))


@query("estimable_drifts", f"SELECT session, coalesce(bool_or(times > 1), false) AND sum(visits) >= count(*) + 1 AS estimable FROM (SELECT session, station, count(*) AS visits, count(DISTINCT seconds) AS times FROM ({VISITS}) GROUP BY ALL) GROUP BY session")
def estimable_drifts(spark, sf):
    return builders.estimable_drifts(gravimetry.occupations(readings(spark, sf), ORDER))


@query("datum_defects", "SELECT CAST(p_size AS VARCHAR) AS network_id, CASE p_size % 4 WHEN 0 THEN 'x,y,rotation' WHEN 1 THEN 'x,y,scale' WHEN 2 THEN 'x,y' ELSE 'x,y,rotation,scale' END AS defect FROM part GROUP BY ALL")
def datum_defects(spark, sf):
    kinds = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("HORIZONTAL_DISTANCE"), F.lit("DIRECTION"))).when(F.col("p_size") % 4 == 1, F.array(F.lit("AZIMUTH"))).when(F.col("p_size") % 4 == 2, F.array(F.lit("AZIMUTH"), F.lit("HORIZONTAL_DISTANCE"))).otherwise(F.array(F.lit("HORIZONTAL_ANGLE")))
    obs = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("network_id"), F.explode(kinds).alias("type"))
    return builders.detect_defect(obs, "plane_2d").select("network_id", F.array_join("defect", ",").alias("defect"))


@query("support_findings", "SELECT CAST(p_size AS VARCHAR) AS network_id, CASE WHEN p_partkey % 3 = 0 THEN 'GRAVITY' ELSE 'ZENITH_ANGLE' END AS type, count(*) AS n FROM part WHERE p_partkey % 3 < 2 GROUP BY ALL")
def support_findings(spark, sf):
    k = F.col("p_partkey") % 3
    obs = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("network_id"), F.when(k == 0, "GRAVITY").when(k == 1, "ZENITH_ANGLE").otherwise("AZIMUTH").alias("type"))
    return builders.support_findings(obs, "plane_2d")


@query("weighted_constraints", "SELECT 'constraint:' || c_custkey || ':' || c AS obs, round(v,6)+0.0 AS value, s AS variance FROM (SELECT c_custkey, unnest(['x','y']) AS c, unnest([c_acctbal, c_acctbal/2]) AS v, unnest([CAST(0.25 AS DOUBLE), 0.5]) AS s FROM customer WHERE c_custkey % 3 = 0)")
def weighted_constraints(spark, sf):
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").select(F.lit("n").alias("network_id"), k.cast("string").alias("station"), F.col("c_acctbal").alias("x"), (F.col("c_acctbal") / 2).alias("y"), F.lit(None).cast("double").alias("z"), (k % 3 == 1).alias("fixed"), F.when(k % 3 < 2, 0.25).alias("variance_x"), F.when(k % 3 < 2, 0.5).alias("variance_y"), F.lit(1.0).alias("variance_z"))
    return builders.weighted_constraints(s).select("obs", r(F.col("value")).alias("value"), "variance")


def _faces(spark, sf):
    return points(spark, sf).select(F.col("point").alias("target"), F.when(F.col("point") % 2 == 0, "D").otherwise("R").alias("face"), F.lit("i").alias("instrument"), (F.col("longitude") + math.pi).alias("horizontal"), F.when(F.col("point") % 2 == 0, 1.5 + F.col("latitude") / 10).otherwise(2 * math.pi - 1.5 - F.col("latitude") / 10).alias("zenith"), F.lit(4e-10).alias("horizontal_variance"), F.lit(9e-10).alias("zenith_variance"))


@query("single_faces", "SELECT point AS target, round(CASE WHEN h < 0 THEN h + 2*pi() ELSE h END,9)+0.0 AS horizontal, round(1.5+latitude/10-2e-5,9)+0.0 AS zenith, 5e-10 AS horizontal_variance FROM (SELECT *, longitude+pi()-1e-5*(CASE WHEN point % 2 = 0 THEN 1 ELSE -1 END)-(CASE WHEN point % 2 = 0 THEN 0 ELSE pi() END) AS h FROM {points})")
def single_faces(spark, sf):
    instruments = spark.createDataFrame([("i", 1e-5, 2e-5, 1e-10, 1e-10)], "instrument string, collimation double, vertical_index double, collimation_variance double, vertical_index_variance double")
    return builders.single_face(_faces(spark, sf), instruments).select("target", r(F.col("horizontal"), 9).alias("horizontal"), r(F.col("zenith"), 9).alias("zenith"), r(F.col("horizontal_variance"), 15).alias("horizontal_variance"))


@query("trunnion_tilt", "SELECT point AS target, round(longitude+pi()+1e-3*cos(1.5+latitude/10)/sin(1.5+latitude/10),9)+0.0 AS horizontal FROM {points}")
def trunnion_tilt(spark, sf):
    rows = _faces(spark, sf).withColumn("zenith", F.when(F.col("face") == "D", F.col("zenith")).otherwise(2 * math.pi - F.col("zenith")))
    return builders.trunnion(rows, F.lit(1e-3), F.lit(1e-10)).select("target", r(F.col("horizontal"), 9).alias("horizontal"))


@query("resolved_sigmas", "SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN p_retailprice/1e6 WHEN p_size % 3 = 1 THEN 2e-6/sqrt(p_size) ELSE 5e-6/sqrt(p_size) END,12)+0.0 AS sigma, CASE p_size % 3 WHEN 0 THEN 'STATED' WHEN 1 THEN 'NOMINAL_PRECISION' ELSE 'TYPE_DEFAULT' END AS source FROM part")
def resolved_sigmas(spark, sf):
    k = F.col("p_size") % 3
    sigma, source = builders.resolved_sigma(F.when(k == 0, F.col("p_retailprice") / 1e6), F.when(k == 1, 2e-6), F.lit(5e-6), F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", r(sigma, 12).alias("sigma"), source.alias("source"))


@query("total_station_observations", "SELECT 'n' || point % 40 || ':' || point || ':' || type AS obs, round(value,6)+0.0 AS value, round(1e9*variance,6)+0.0 AS variance FROM (SELECT point, unnest(['HEIGHT_DIFFERENCE', 'HORIZONTAL_DISTANCE', 'SLOPE_DISTANCE', 'ZENITH_ANGLE', 'DIRECTION']) AS type, unnest([d*cos(z)+0.2, d*sin(z), d, z, longitude]) AS value, unnest([cos(z)*cos(z)*4e-6+d*d*sin(z)*sin(z)*9e-10, sin(z)*sin(z)*4e-6+d*d*cos(z)*cos(z)*9e-10, 4e-6, 9e-10, 4e-10]) AS variance FROM (SELECT *, 1.5+latitude/10 AS z, 100+height/10 AS d FROM {points}))")
def total_station_observations(spark, sf):
    """Every kind of observation that a reduced pointing gives, over the three dimensions."""
    p = points(spark, sf).select(F.lit("n").alias("network_id"), F.concat(F.lit("n"), (F.col("point") % 40).cast("string")).alias("setup"), F.lit("A").alias("station"), F.col("point").cast("string").alias("target"), F.col("longitude").alias("horizontal"), (1.5 + F.col("latitude") / 10).alias("zenith"), (100 + F.col("height") / 10).alias("distance"), F.lit(4e-10).alias("horizontal_variance"), F.lit(9e-10).alias("zenith_variance"), F.lit(4e-6).alias("distance_variance"), F.lit(1.5).alias("instrument_height"), F.lit(1.3).alias("target_height"))
    rows = builders.total_station_observations(p, 1).unionByName(builders.total_station_observations(p, 2)).unionByName(builders.total_station_observations(p, 3)).dropDuplicates(["obs"])
    return rows.select("obs", r(F.col("value")).alias("value"), r(F.col("variance") * 1e9).alias("variance"))


@query("distances_to_grid", "SELECT c_custkey AS obs, round(1000.0*6371000.0/(6371000+c_acctbal/2)*((1+0)+4*(1+250e-9)+(1+500e-9))/6,6)+0.0 AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, CAST(0.5 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 1")
def distances_to_grid(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    obs = c.select(F.lit("n").alias("network_id"), k.alias("obs"), F.when(k % 2 == 0, "HORIZONTAL_DISTANCE").otherwise("AZIMUTH").alias("type"), F.lit("A").alias("at"), k.cast("string").alias("to"), F.when(k % 2 == 0, 1000.0).otherwise(0.5).alias("value"), F.lit(1e-6).alias("variance"))
    ends = c.select(F.lit("n").alias("network_id"), k.cast("string").alias("station"), F.lit(500.0).alias("x"), F.lit(0.0).alias("y"), F.col("c_acctbal").alias("z"))
    start = spark.createDataFrame([("n", "A", 0.0, 0.0, 0.0)], ends.schema)
    return builders.distances_to_grid(obs, ends.unionByName(start), lambda x, y: 1.0 + x * 1e-9).select("obs", r(F.col("value")).alias("value"))


@query("baseline_marks", f"SELECT baseline, round(dx-1.5+2.0,6)+0.0 AS dx, round(dy,6)+0.0 AS dy, round(dz+0.1,6)+0.0 AS dz, round(1e6*(1e-6+4e-6+1e-6),6)+0.0 AS cxx FROM ({BASELINES})")
def baseline_marks(spark, sf):
    """Antenna offsets at a base and a rover on the equator and the first meridian, where east, north and up are y, z and x."""
    b = _baselines(spark, sf).withColumns({"base_latitude": F.lit(0.0), "base_longitude": F.lit(0.0), "rover_latitude": F.lit(0.0), "rover_longitude": F.lit(0.0), "base_e": F.lit(0.0), "base_n": F.lit(0.1), "base_u": F.lit(2.0), "rover_e": F.lit(0.0), "rover_n": F.lit(0.0), "rover_u": F.lit(1.5)})
    b = b.withColumns({f"{end}_{c}_variance": F.lit(v) for end, v in (("base", 4e-6), ("rover", 1e-6)) for c in "enu"})
    m = builders.reduced_to_marks(b)
    return m.select("baseline", *(r(F.col(f"d{c}")).alias(f"d{c}") for c in "xyz"), r(F.col("cxx") * 1e6).alias("cxx"))


@query("baseline_clusters", f"SELECT baseline || ':' || c AS obs, round(v,6)+0.0 AS value, CAST(1.0 AS DOUBLE) AS variance, CASE c WHEN 'X' THEN 2 WHEN 'Y' THEN 1 ELSE 0 END AS shared FROM (SELECT baseline, unnest(['X','Y','Z']) AS c, unnest([dx, dy, dz]) AS v FROM ({BASELINES}))")
def baseline_clusters(spark, sf):
    rows, shared = builders.baseline_cluster(_baselines(spark, sf))
    n = shared.groupBy(F.col("obs_a").alias("obs")).agg(F.count("*").cast("int").alias("shared"))
    return rows.join(n, "obs", "left").select("obs", r(F.col("value")).alias("value"), r(F.col("variance") * 1e6).alias("variance"), F.coalesce("shared", F.lit(0)).alias("shared"))


RANKED = f"SELECT baseline, base, rover, row_number() OVER (ORDER BY baseline % 1009, CAST(baseline AS VARCHAR)) AS rank, dx, dy, dz FROM ({BASELINES})"
FOREST = f"""b AS ({RANKED}), p AS (SELECT least(base, rover) AS a, greatest(base, rover) AS c, min(rank) AS rank FROM b GROUP BY ALL),
reach AS (SELECT p.rank AS edge, p.a AS goal, p.c AS here FROM p UNION SELECT reach.edge, goal, CASE WHEN e.a = here THEN e.c ELSE e.a END FROM reach JOIN p e ON e.rank < reach.edge AND here IN (e.a, e.c)),
f AS (SELECT b.* FROM b JOIN p USING (rank) WHERE rank NOT IN (SELECT edge FROM reach WHERE here = goal))"""


def _ranked(spark, sf):
    unit = {c: F.lit(0.0) for c in ("cyy", "czz", "cxy", "cxz", "cyz")}
    return _baselines(spark, sf).withColumns(unit | {"cxx": (F.col("baseline") % 1009 + 1).cast("double")})


@query("independent_baselines", f"WITH RECURSIVE {FOREST} SELECT baseline FROM f")
def independent_baselines(spark, sf):
    """The best spanning forest: a baseline is in it unless better ones join its ends."""
    return builders.independent_subset(_ranked(spark, sf)).where("independent").select("baseline")


@query("closing_loops", f"""WITH RECURSIVE {FOREST},
w AS (SELECT base AS u, rover AS v, baseline, 1 AS s, dx FROM f UNION ALL SELECT rover, base, baseline, -1, dx FROM f),
c AS (SELECT d.baseline AS loop, d.base AS goal, d.rover AS here, [d.rover] AS seen, 1 AS legs, d.dx AS closure FROM b d WHERE d.baseline NOT IN (SELECT baseline FROM f)
 UNION ALL SELECT loop, goal, v, list_append(seen, v), legs + 1, closure + s*dx FROM c JOIN w ON w.u = c.here WHERE here <> goal AND NOT list_contains(seen, v))
SELECT loop, CAST(legs AS BIGINT) AS legs, round(closure,5)+0.0 AS closure FROM c WHERE here = goal AND legs > 2""")
def closing_loops(spark, sf):
    """The circuit that each other baseline closes, with the sum of its first components."""
    own = builders.independent_subset(_ranked(spark, sf))
    legs = builders.closing_loops(own).join(own.select("baseline", "dx"), "baseline")
    return legs.groupBy("loop").agg(F.count("*").alias("legs"), r(F.sum(F.col("sign") * F.col("dx")), 5).alias("closure"))


# ---- matrices: one of three rows a part, [[a, c, 0], [c, b, 0], [0, 0, 2]]
PARTS = "SELECT p_partkey AS k, p_retailprice AS a, p_size + 1000.0 AS b, p_size * 1.0 AS c FROM part"


def _matrices(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("a"), (F.col("p_size") + 1000.0).alias("b"), F.col("p_size").cast("double").alias("c"))
    e = lambda i, j, v: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v"))
    return p.select("k", F.explode(F.array(e("p", "p", F.col("a")), e("p", "q", F.col("c")), e("q", "p", F.col("c")), e("q", "q", F.col("b")), e("s", "s", F.lit(2.0)))).alias("e")).select("k", "e.*")


@query("matrix_correlation", f"SELECT k, round(c/sqrt(a*b),9)+0.0 AS v FROM ({PARTS})")
def matrix_correlation(spark, sf):
    return matrices.correlation(matrices.sub_block(_matrices(spark, sf), ["p", "q"]), ["k"]).where("i = 'p' and j = 'q'").select("k", r(F.col("v"), 9).alias("v"))


@query("matrix_quadratic_form", f"SELECT k, round(a+4*b+4*c+18,4)+0.0 AS v FROM ({PARTS})")
def matrix_quadratic_form(spark, sf):
    m = _matrices(spark, sf)
    v = m.select("k", "i").distinct().withColumn("v", F.when(F.col("i") == "p", 1.0).when(F.col("i") == "q", 2.0).otherwise(3.0))
    return matrices.quadratic_form(m, v, ["k"]).select("k", r(F.col("v"), 4).alias("v"))


@query("matrix_product_diagonal", f"SELECT k, unnest(['p','q','s']) AS i, round(unnest([a*a+c*c, b*b+c*c, 4.0]),3)+0.0 AS v FROM ({PARTS})")
def matrix_product_diagonal(spark, sf):
    m = _matrices(spark, sf)
    return matrices.product_diagonal(m, m, ["k"]).select("k", "i", r(F.col("v"), 3).alias("v"))


@query("matrix_inverse_diagonal", f"SELECT k, unnest(['p','q','s']) AS i, round(unnest([b/(a*b-c*c), a/(a*b-c*c), 0.5]),9)+0.0 AS v FROM ({PARTS})")
def matrix_inverse_diagonal(spark, sf):
    return matrices.inverse_diagonal(_matrices(spark, sf), ["k"]).select("k", "i", r(F.col("v"), 9).alias("v"))


@query("matrix_zero_rounded", f"SELECT k, unnest(['pp','pq','qp','qq','ss']) AS e, round(unnest([CASE WHEN k % 2 = 0 THEN 0 ELSE a END, CASE WHEN k % 2 = 0 THEN 0 ELSE c END, CASE WHEN k % 2 = 0 THEN 0 ELSE c END, b, 2.0]),6)+0.0 AS v FROM ({PARTS})")
def matrix_zero_rounded(spark, sf):
    m = _matrices(spark, sf).withColumn("v", F.when((F.col("k") % 2 == 0) & (F.col("i") == "p") & (F.col("j") == "p"), -1e-13).otherwise(F.col("v")))
    return matrices.zero_rounded(m, ["k"]).select("k", F.concat("i", "j").alias("e"), r(F.col("v")).alias("v"))


@query("weight_entries", f"SELECT k, unnest(['p:p','p:q','q:p','q:q','s:s']) AS e, round(unnest([b/(a*b-c*c), -c/(a*b-c*c), -c/(a*b-c*c), a/(a*b-c*c), 0.5]),9)+0.0 AS v FROM ({PARTS})")
def weight_entries(spark, sf):
    """Weights of three observations a network, of which two are correlated."""
    m = _matrices(spark, sf).withColumn("network_id", F.col("k").cast("string"))
    obs = m.where("i = j").select("network_id", F.col("i").alias("obs"), F.col("v").alias("variance"))
    cov = m.where("i = 'p' and j = 'q'").select("network_id", F.col("i").alias("obs_a"), F.col("j").alias("obs_b"), F.col("v").alias("covariance"))
    return matrices.weight_entries(obs, cov).select(F.col("network_id").cast("long").alias("k"), F.concat_ws(":", "i", "j").alias("e"), r(F.col("v"), 9).alias("v"))


# ---- solutions
def _pairs_of_stations(spark, sf):
    """Cofactors of two stations with equal spread s and cross-covariance t on both axes."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("network_id"), (F.col("c_custkey") % 7 + 3.0).alias("s"), (F.col("c_custkey") % 3).cast("double").alias("t"))
    e = lambda i, j, v: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("q"))
    own = [e(f"{p}:{x}", f"{q}:{x}", F.col("s") * (4.0 if x == "x" else 1.0) if p == q else F.col("t")) for p in "AB" for q in "AB" for x in "xy"]
    return c.select("network_id", F.explode(F.array(*own)).alias("e")).select("network_id", "e.*")


@query("relative_ellipses", "SELECT CAST(c_custkey AS VARCHAR) AS network_id, round(2*sqrt(8*s-2*t),6)+0.0 AS semi_major, round(2*sqrt(2*s-2*t),6)+0.0 AS semi_minor, round(pi()/2,6) AS azimuth, round(2*sqrt(8*s-2*t),6)+0.0 AS positional_uncertainty FROM (SELECT c_custkey, c_custkey % 7 + 3.0 AS s, c_custkey % 3 * 1.0 AS t FROM customer)")
def relative_ellipses(spark, sf):
    c = _pairs_of_stations(spark, sf)
    pairs = c.select("network_id").distinct().withColumns({"a": F.lit("A"), "b": F.lit("B")})
    e = solutions.positional_uncertainty(solutions.relative_ellipses(c, pairs, 2.0))
    return e.select("network_id", *(r(F.col(x)).alias(x) for x in ("semi_major", "semi_minor", "azimuth", "positional_uncertainty")))


@query("solution_differences", "SELECT CAST(coalesce(a.p_partkey, b.p_partkey) AS BIGINT) AS station, round(b.x-a.x,6)+0.0 AS d_x, abs(b.x-a.x) <= 0.5 AS agrees_x, CASE WHEN b.p_partkey IS NULL THEN 'reference' WHEN a.p_partkey IS NULL THEN 'other' END AS only_in FROM (SELECT p_partkey, p_retailprice AS x FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey, p_retailprice + p_size/50.0 AS x FROM part WHERE p_partkey % 7 <> 0) b ON a.p_partkey = b.p_partkey")
def solution_differences(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("station"), F.col("p_retailprice").alias("x"))
    b = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("station"), (F.col("p_retailprice") + F.col("p_size") / 50.0).alias("x"))
    return solutions.compare_solutions(a, b, ["station"], {"x": 0.5}).select("station", r(F.col("d_x")).alias("d_x"), "agrees_x", "only_in")


@query("incomparable_solutions", "SELECT a.n_nationkey AS first, b.n_nationkey AS second, concat_ws(',', CASE WHEN a.n_regionkey <> b.n_regionkey THEN 'frame' END, CASE WHEN a.n_nationkey % 2 <> b.n_nationkey % 2 THEN 'height_type' END) AS reasons FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def incomparable_solutions(spark, sf):
    d = table(spark, sf, "nation").select(F.col("n_nationkey").alias("solution"), F.col("n_regionkey").alias("frame"), (F.col("n_nationkey") % 2).alias("height_type"))
    return solutions.incomparable(d, d).select("first", "second", F.array_join("reasons", ",").alias("reasons"))


@query("solutions_using", "SELECT o_custkey AS solution, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS observations FROM orders WHERE o_orderkey % 97 = 0 GROUP BY o_custkey")
def solutions_using(spark, sf):
    o = table(spark, sf, "orders")
    s = o.groupBy(F.col("o_custkey").alias("solution")).agg(F.collect_list("o_orderkey").alias("observations"))
    used = solutions.solutions_using(s, o.where("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("obs")))
    return used.select("solution", F.array_join("observations", ",").alias("observations"))


@query("solution_deletions", "SELECT c_custkey AS solution, CASE WHEN (c_custkey + 1) % 5 <> 0 OR c_custkey = (SELECT max(c_custkey) FROM customer) THEN c_custkey + 1 END AS superseded_by FROM customer WHERE c_custkey % 5 <> 0")
def solution_deletions(spark, sf):
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("solution"), (F.col("c_custkey") + 1).alias("superseded_by"))
    return solutions.delete_solution(s, s.where("solution % 5 = 0"))


@query("map_exaggerations", "SELECT block, CASE WHEN raw > 1 THEN pow(10, floor(log10(raw))) * CASE WHEN raw / pow(10, floor(log10(raw))) >= 5 THEN 5 WHEN raw / pow(10, floor(log10(raw))) >= 2 THEN 2 ELSE 1 END ELSE 1 END AS exaggeration FROM (SELECT c_custkey % 20 AS block, 0.05*least(max(c_custkey % 97 * 10.0)-min(c_custkey % 97 * 10.0), max(c_custkey % 89 * 10.0)-min(c_custkey % 89 * 10.0))/(2*max(1e-4*(c_custkey % 97))) AS raw FROM customer GROUP BY 1)")
def map_exaggerations(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select((k % 20).alias("block"), (k % 97 * 10.0).alias("x"), (k % 89 * 10.0).alias("y"), (1e-4 * (k % 97)).alias("size"))
    return solutions.default_exaggeration(rows, ["block"], "size")


@query("displacement_arrows", "SELECT c_custkey AS station, CAST(c_custkey AS DOUBLE) AS x, CAST(c_custkey + 50.0 * (c_custkey % 7) AS DOUBLE) AS tip_x, CAST(3.0 + 50.0 * (c_custkey % 5) AS DOUBLE) AS tip_y FROM customer")
def displacement_arrows(spark, sf):
    k = F.col("c_custkey")
    a = solutions.displacement_arrow(k.cast("double"), F.lit(3.0), (k % 7).cast("double"), (k % 5).cast("double"), 50.0)
    return table(spark, sf, "customer").select(k.alias("station"), a[0].x.alias("x"), a[1].x.alias("tip_x"), a[1].y.alias("tip_y"))


CURVES = "SELECT station, epoch, o, 1.96*sqrt(vx) AS h FROM (SELECT *, x - first_value(x) OVER (PARTITION BY station ORDER BY epoch) AS o FROM {epochs})"


def _curves(spark, sf):
    from meridian.operators import monitoring
    from meridian.plans.registry import epochs

    e = epochs(spark, sf)
    s = monitoring.series(e).select("station", "epoch", "ox").join(e.select("station", "epoch", F.col("vx").alias("qx")), ["station", "epoch"])
    return solutions.series_curves(s, "x")


@query("series_curves", f"SELECT station, CAST(epoch AS DOUBLE) AS epoch, round(o,6)+0.0 AS value, round(o-h,6)+0.0 AS low, round(o+h,6)+0.0 AS high FROM ({CURVES})")
def series_curves(spark, sf):
    return _curves(spark, sf).select("station", "epoch", *(r(F.col(c)).alias(c) for c in ("value", "low", "high")))


@query("series_limits", f"SELECT station, round(min(o-h),6)+0.0 AS low, round(max(o+h),6)+0.0 AS high, CAST(min(epoch) AS DOUBLE) AS first, CAST(max(epoch) AS DOUBLE) AS last FROM ({CURVES}) GROUP BY station")
def series_limits(spark, sf):
    s = solutions.series_limits(_curves(spark, sf))
    return s.select("station", r(F.col("low")).alias("low"), r(F.col("high")).alias("high"), "first", "last")


@query("trajectory_features", "SELECT event_id, row_number() OVER w AS place, round(sqrt(pow(value-lag(value) OVER w,2)),6)+0.0 AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def trajectory_features(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_id").alias("instant"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return solutions.trajectory_features(e).select("event_id", F.col("place").cast("long").alias("place"), r(F.col("step")).alias("step"))


@query("constrained_stations", "SELECT CAST(n_nationkey AS VARCHAR) AS station FROM nation WHERE n_nationkey = 0")
def constrained_stations(spark, sf):
    return solutions.constrained_stations(_height_network(spark, sf)[0]).select("station")


@query("congruency_of_correlated_stations", "SELECT p_partkey AS campaign, round((b*d*d-2*c*d*g+a*g*g)/(a*b-c*c),5)+0.0 AS omega, 2 AS h FROM (SELECT p_partkey, p_retailprice AS a, p_size + 1000.0 AS b, p_size * 1.0 AS c, p_partkey % 11 - 5.0 AS d, p_size % 7 - 3.0 AS g FROM part)")
def congruency_of_correlated_stations(spark, sf):
    """Two heights a campaign with a full covariance."""
    from meridian.operators import congruency

    m = matrices.sub_block(_matrices(spark, sf), ["p", "q"]).select(F.col("k").alias("campaign"), F.concat("i", F.lit(":z")).alias("i"), F.concat("j", F.lit(":z")).alias("j"), "v")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("campaign"), F.explode(F.array(F.struct(F.lit("p").alias("s"), (F.col("p_partkey") % 11 - 5.0).alias("v")), F.struct(F.lit("q").alias("s"), (F.col("p_size") % 7 - 3.0).alias("v")))).alias("e")).select("campaign", "e.*")
    d = p.select("campaign", F.concat("s", F.lit(":z")).alias("i"), "v")
    places = p.select("campaign", F.col("s").alias("station"), *(F.lit(0.0).alias(c) for c in "xyz"), F.lit(True).alias("reference"))
    meta = p.select("campaign").distinct().withColumns({"pooled": F.lit(1.0), "dof": F.lit(0)})
    found = congruency.congruency(d, m, places, meta, ["campaign"])
    return found.select("campaign", r(F.col("omega"), 5).alias("omega"), "h").distinct()


@query("s_transformed_differences", "WITH d AS (SELECT n_regionkey AS campaign, n_nationkey AS k, n_nationkey % 7 * 0.5 AS dx, n_nationkey % 5 * 0.25 AS dy FROM nation), m AS (SELECT campaign, avg(dx) AS mx, avg(dy) AS my, count(*) AS n FROM d WHERE k % 2 = 0 GROUP BY campaign) SELECT d.campaign, 'S' || k AS station, round(dx-mx,6)+0.0 AS dx, round(dy-my,6)+0.0 AS dy, round(CASE WHEN k % 2 = 0 THEN 1-1.0/n ELSE 1+1.0/n END,6)+0.0 AS variance FROM d JOIN m ON d.campaign = m.campaign")
def s_transformed_differences(spark, sf):
    """Differences of independent stations in the datum of some of them (translations)."""
    from meridian.operators import congruency

    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("campaign"), F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("station"), (F.col("n_nationkey") % 7 * 0.5).alias("x"), (F.col("n_nationkey") % 5 * 0.25).alias("y"), (F.col("n_nationkey") % 2 == 0).alias("reference"))
    d = n.select("campaign", "station", F.explode(F.array(F.struct(F.lit("x").alias("c"), F.col("x").alias("v")), F.struct(F.lit("y").alias("c"), F.col("y").alias("v")))).alias("e")).select("campaign", F.concat_ws(":", "station", "e.c").alias("i"), "e.v")
    q = d.select("campaign", "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    meta = n.select("campaign").distinct().withColumns({"pooled": F.lit(1.0), "dof": F.lit(10)})
    found = congruency.congruency(d, q, n.withColumn("z", F.lit(0.0)), meta, ["campaign"], ("x", "y"))
    pick = lambda c, v: F.max(F.when(F.expr("substring_index(i, ':', -1)") == c, F.col(v)))
    return found.groupBy("campaign", F.expr("substring_index(i, ':', 1)").alias("station")).agg(r(pick("x", "v")).alias("dx"), r(pick("y", "v")).alias("dy"), r(pick("x", "variance")).alias("variance"))


@query("combined_stations", "SELECT 'P' || k AS station, CASE WHEN k % 4 = 0 THEN k*2.0 WHEN k % 3 = 0 THEN k*1.0 ELSE k*2.0 END::DOUBLE AS x, k % 4 = 0 AS fixed FROM (SELECT p_partkey AS k FROM part) WHERE k % 2 = 0 OR k % 3 = 0")
def combined_stations(spark, sf):
    """Stations of two techniques, one of which holds some."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    own = lambda factor, fixed: [F.lit("n").alias("network_id"), F.concat(F.lit("P"), F.col("k").cast("string")).alias("station"), (F.col("k") * factor).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), fixed.alias("fixed")]
    first = p.where("k % 3 = 0").select(*own(1.0, F.lit(False)))
    second = p.where("k % 2 = 0").select(*own(2.0, F.col("k") % 4 == 0))
    none = spark.createDataFrame([], "network_id string, obs string")
    stations, _ = builders.combined({"gnss": (first, none), "level": (second, none)})
    return stations.select("station", "x", "fixed")


# ---- geoid

#: Two grids: retail prices on a coarse one, account balances of suppliers on a fine one inside it.
_GRIDS = {
    "coarse": ("part", "p_partkey", "p_retailprice", 20, -0.8, -3.0, 0.05, 0.3),
    "fine": ("supplier", "s_suppkey", "s_acctbal", 5, -0.5, -1.0, 0.02, 0.2),
}


def _grid_cells(spark, sf):
    out = None
    for name, (source, key, value, columns, *place) in _GRIDS.items():
        k = F.col(key)
        fixed = [F.lit(x).alias(n) for n, x in zip(("south", "west", "dlat", "dlon"), place, strict=True)]
        own = table(spark, sf, source).select(F.lit(name).alias("path"), F.floor(k / columns).cast("int").alias("row"), (k % columns).cast("int").alias("column"), (F.col(value) / 100.0).cast("double").alias("value"), *fixed)
        out = own if out is None else out.unionByName(own)
    return out


_CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS path, {key} // {columns} AS i, {key} % {columns} AS j, {value} / 100.0 AS v, {south} AS south, {west} AS west, {dlat} AS dlat, {dlon} AS dlon FROM {source}"
    for name, (source, key, value, columns, south, west, dlat, dlon) in _GRIDS.items()
)


@query("geoid_undulations", f"""
WITH c AS ({_CELLS_SQL}), g AS (SELECT path, any_value(south) AS south, any_value(west) AS west, any_value(dlat) AS dlat, any_value(dlon) AS dlon, max(i)+1 AS rows, max(j)+1 AS cols FROM c GROUP BY path),
p AS (SELECT point, latitude, longitude, path, rows, cols, round((latitude-south)/dlat, 9) AS y, round((longitude-west)/dlon, 9) AS x, dlat*dlon AS size FROM {{points}}, g),
n AS (SELECT * FROM p WHERE y BETWEEN 0 AND rows-1 AND x BETWEEN 0 AND cols-1 AND rows > 1 AND cols > 1 QUALIFY row_number() OVER (PARTITION BY point ORDER BY size, path) = 1),
k AS (SELECT *, y-r AS t, x-q AS u FROM (SELECT *, CAST(least(floor(y), rows-2) AS BIGINT) AS r, CAST(least(floor(x), cols-2) AS BIGINT) AS q FROM n)),
b AS (SELECT point, sum(CASE WHEN i = r THEN 1-t ELSE t END * CASE WHEN j = q THEN 1-u ELSE u END * v) AS undulation FROM k JOIN c ON c.path = k.path AND i BETWEEN r AND r+1 AND j BETWEEN q AND q+1 GROUP BY point),
d AS (SELECT c.path, c.i, c.j, CASE WHEN count(s.v) = 2 THEN abs(sum(s.v) - 2*any_value(c.v)) END AS second, 'row' AS axis FROM c JOIN c s ON s.path = c.path AND s.j = c.j AND abs(s.i - c.i) = 1 GROUP BY ALL
  UNION ALL SELECT c.path, c.i, c.j, CASE WHEN count(s.v) = 2 THEN abs(sum(s.v) - 2*any_value(c.v)) END, 'column' FROM c JOIN c s ON s.path = c.path AND s.i = c.i AND abs(s.j - c.j) = 1 GROUP BY ALL),
e AS (SELECT point, coalesce(max(CASE WHEN axis = 'row' THEN second END), 0) AS by_row, coalesce(max(CASE WHEN axis = 'column' THEN second END), 0) AS by_column FROM k LEFT JOIN d ON d.path = k.path AND
  (axis = 'row' AND rows >= 3 AND j BETWEEN q AND q+1 AND i BETWEEN least(greatest(r, 1), rows-2) AND least(greatest(r+1, 1), rows-2) OR axis = 'column' AND cols >= 3 AND i BETWEEN r AND r+1 AND j BETWEEN least(greatest(q, 1), cols-2) AND least(greatest(q+1, 1), cols-2)) GROUP BY point)
SELECT p.point, k.path AS grid, round(undulation, 11)+0.0 AS undulation, round(0.5*(by_row*t*(1-t)+by_column*u*(1-u)), 11)+0.0 AS interpolation_sigma FROM (SELECT point FROM {{points}}) p LEFT JOIN k ON k.point = p.point LEFT JOIN b ON b.point = p.point LEFT JOIN e ON e.point = p.point""")
def geoid_undulations(spark, sf):
    """Undulations with the sigma of their interpolation, over two grids of unlike spacing."""
    found = geoid.undulations(points(spark, sf), _grid_cells(spark, sf))
    return found.select("point", "grid", r(F.col("undulation"), 11).alias("undulation"), r(F.col("interpolation_sigma"), 11).alias("interpolation_sigma"))


_LEVELLED = "(a + b) % 3 = 0"
_WITH_GEOID = f"""
SELECT a || '-' || b AS obs, CASE WHEN {_LEVELLED} THEN CAST(a AS VARCHAR) ELSE 'ellipsoidal:' || a END AS a, CASE WHEN {_LEVELLED} THEN CAST(b AS VARCHAR) ELSE 'ellipsoidal:' || b END AS b, difference AS l, n/1e6 AS w FROM {{edges}}
UNION ALL SELECT 'ellipsoidal:' || s, CAST(s AS VARCHAR), 'ellipsoidal:' || s, 40 + s/10.0, 1/2500.0 FROM (SELECT DISTINCT unnest([a, b]) AS s FROM {{edges}} WHERE NOT ({_LEVELLED}))"""


@query("geoid_residuals", solved_sql(_WITH_GEOID, "0", "SELECT v.a AS station, round(l,6)+0.0 AS model, round(l+v,5)+0.0 AS adjusted, round(v,5)+0.0 AS residual, round(1-w*spread,6)+0.0 AS redundancy, round(CASE WHEN 1-w*spread > 1e-6 THEN v/sqrt((1-w*spread)/w) END,4)+0.0 AS standardised FROM v WHERE obs LIKE 'ellipsoidal:%'"))
def geoid_residuals(spark, sf):
    """Levelled and ellipsoidal height differences together, with a geoid model's undulations as parameters."""
    stations, observations = _height_network(spark, sf)
    a, b = (F.split("obs", "-")[k].cast("int") for k in (0, 1))
    kinds = observations.withColumn("height_type", F.when((a + b) % 3 == 0, "orthometric").otherwise("ellipsoidal"))
    models = stations.select("network_id", "station", (40 + F.col("station").cast("int") / 10.0).alias("undulation"), F.lit(2500.0).alias("undulation_variance"))
    whole, rows = geoid.with_undulations(stations, kinds, models)
    out = geoid.geoid_residuals(adjustment.adjust(whole, rows, "height_1d")["residuals"], rows)
    return out.select("station", r(F.col("model")).alias("model"), *(r(F.col(c), 5).alias(c) for c in ("adjusted", "residual")), r(F.col("redundancy")).alias("redundancy"), r(F.col("standardised"), 4).alias("standardised"))
