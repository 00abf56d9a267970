"""Queries of estimation and monitoring: adjustments, statistics, epochs, alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.functions import distributions as dist
from meridian.operators import adjustment, monitoring, network, starting
from meridian.plans.registry import edges, epochs, query, r, table


def _height_network(spark, sf):
    """Nations as stations, the mean account differences of supplier and customer nations as height differences; nation 0 is held."""
    stations = table(spark, sf, "nation").select(F.lit("n1").alias("network_id"), F.col("n_nationkey").cast("string").alias("station"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (F.col("n_nationkey") == 0).alias("fixed"))
    e = edges(spark, sf)
    none = F.lit(None).cast("string")
    observations = e.select("network_id", F.concat_ws("-", "a", "b").alias("obs"), F.lit("HEIGHT_DIFFERENCE").alias("type"), F.col("a").cast("string").alias("at"), F.col("b").cast("string").alias("to"), none.alias("third"), F.col("difference").alias("value"), (1e6 / F.col("n")).alias("variance"), none.alias("setup"))
    return stations, observations


@query("normal_matrix", """
WITH t AS (SELECT a || '-' || b AS obs, n/1e6 AS w, CAST(b AS VARCHAR) || ':z' AS p, 1.0 AS v FROM {edges} UNION ALL SELECT a || '-' || b, n/1e6, CAST(a AS VARCHAR) || ':z', -1.0 FROM {edges})
SELECT x.p AS i, y.p AS j, round(sum(x.w*x.v*y.v),9)+0.0 AS n FROM t x JOIN t y ON x.obs = y.obs WHERE x.p <> '0:z' AND y.p <> '0:z' GROUP BY ALL""")
def normal_matrix(spark, sf):
    stations, observations = _height_network(spark, sf)
    rows = adjustment.with_coordinates(observations, stations).withColumn("orientation", F.lit(0.0))
    design = adjustment.free_only(adjustment.equations(rows), stations)
    return adjustment.normal_matrix(design).select("i", "j", r(F.col("n"), 9).alias("n"))


@query("normal_right_side", "SELECT p || ':z' AS i, round(sum(s*n*difference/1e6),6)+0.0 AS u FROM (SELECT CAST(b AS VARCHAR) AS p, 1.0 AS s, n, difference FROM {edges} UNION ALL SELECT CAST(a AS VARCHAR), -1.0, n, difference FROM {edges}) WHERE p <> '0' GROUP BY p")
def normal_right_side(spark, sf):
    stations, observations = _height_network(spark, sf)
    rows = adjustment.with_coordinates(observations, stations).withColumn("orientation", F.lit(0.0))
    return adjustment.right_side(adjustment.free_only(adjustment.equations(rows), stations)).select("i", r(F.col("u")).alias("u"))


@query("network_adjustment")
def network_adjustment(spark, sf):
    """Adjusted heights with their variances, factor and degrees of freedom."""
    stations, observations = _height_network(spark, sf)
    out = adjustment.adjust(stations, observations, "height_1d")
    own = out["cofactors"].where("i = j").select("network_id", F.expr("substring(i, 1, length(i) - 2)").alias("station"), F.col("q").alias("cofactor"))
    return out["stations"].join(own, ["network_id", "station"], "left").join(out["statistics"].select("network_id", "dof", "variance_factor"), "network_id").select("network_id", "station", r(F.col("z")).alias("height"), r(F.col("cofactor")).alias("cofactor"), "dof", r(F.col("variance_factor")).alias("variance_factor"))


@query("adjustment_orthogonality", "SELECT DISTINCT p || ':z' AS i, 0.0 AS apv FROM (SELECT CAST(b AS VARCHAR) AS p FROM {edges} UNION ALL SELECT CAST(a AS VARCHAR) FROM {edges}) WHERE p <> '0'")
def adjustment_orthogonality(spark, sf):
    """A'Pv of the adjusted network, which least squares makes zero."""
    stations, observations = _height_network(spark, sf)
    out = adjustment.adjust(stations, observations, "height_1d")
    v = out["residuals"].join(observations.select("network_id", "obs", "at", "to"), ["network_id", "obs"])
    terms = v.select(F.explode(F.array(F.struct(F.col("to").alias("p"), (F.col("weight") * F.col("residual")).alias("t")), F.struct(F.col("at").alias("p"), (-F.col("weight") * F.col("residual")).alias("t")))).alias("e"))
    return terms.where("e.p <> '0'").groupBy(F.concat(F.col("e.p"), F.lit(":z")).alias("i")).agg(r(F.sum("e.t"), 6).alias("apv"))


@query("adjustment_redundancy", "SELECT (SELECT count(*) FROM {edges}) - count(*) AS dof, round((SELECT count(*) FROM {edges}) - count(*), 5) AS redundancy FROM (SELECT DISTINCT p FROM (SELECT b AS p FROM {edges} UNION ALL SELECT a FROM {edges}) WHERE p <> 0)")
def adjustment_redundancy(spark, sf):
    """Redundancies add up to the degrees of freedom."""
    stations, observations = _height_network(spark, sf)
    out = adjustment.adjust(stations, observations, "height_1d")
    total = out["residuals"].groupBy("network_id").agg(F.sum("redundancy").alias("s"))
    return out["statistics"].join(total, "network_id").select("dof", r(F.col("s"), 5).alias("redundancy"))


@query("distributed_adjustment")
def distributed_adjustment(spark, sf):
    """The same network solved over all executors by conjugate gradients."""
    stations, observations = _height_network(spark, sf)
    rows = adjustment.with_coordinates(observations, stations).withColumn("orientation", F.lit(0.0))
    design = adjustment.free_only(adjustment.equations(rows), stations)
    x = adjustment.conjugate_gradient(adjustment.normal_matrix(design), adjustment.right_side(design))
    return x.select(F.expr("substring(i, 1, length(i) - 2)").alias("station"), r(F.col("x"), 4).alias("height"))


@query("data_snooping")
def data_snooping(spark, sf):
    stations, observations = _height_network(spark, sf)
    out = adjustment.adjust(stations, observations, "height_1d")
    tested = adjustment.reliability(adjustment.data_snooping(out["residuals"], out["statistics"], sigma_known=False))
    return tested.select("obs", *(r(F.col(c)).alias(c) for c in ("residual", "redundancy", "w", "critical", "minimal_detectable_bias")), "decision")


@query("global_test")
def global_test(spark, sf):
    stations, observations = _height_network(spark, sf)
    t = adjustment.global_test(adjustment.adjust(stations, observations, "height_1d")["statistics"])
    return t.select("network_id", "dof", r(F.col("vpv")).alias("vpv"), r(F.col("lower")).alias("lower"), r(F.col("upper")).alias("upper"), "tested", "passed")


def _plane_networks(spark, sf):
    """One small plane network a customer group: a quadrilateral with two held corners and all sides and diagonals."""
    corners = spark.createDataFrame([("A", 0.0, 0.0, True), ("B", 100.0, 0.0, True), ("C", 100.0, 100.0, False), ("D", 0.0, 100.0, False)], "station string, cx double, cy double, fixed boolean")
    groups = table(spark, sf, "customer").select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("network_id"), (F.col("c_custkey") % 17 / 10.0).alias("shift"))
    true = groups.join(F.broadcast(corners)).select("network_id", "station", (F.col("cx") + F.when(F.col("fixed"), 0.0).otherwise(F.col("shift"))).alias("x"), (F.col("cy") - F.when(F.col("fixed"), 0.0).otherwise(F.col("shift"))).alias("y"), F.lit(0.0).alias("z"), "fixed", "cx", "cy")
    a, b = true.alias("a"), true.alias("b")
    pairs = a.join(b, F.col("a.network_id") == F.col("b.network_id")).where(F.col("a.station") < F.col("b.station"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    none = F.lit(None).cast("string")
    base = [F.col("a.network_id").alias("network_id"), F.col("a.station").alias("at"), F.col("b.station").alias("to"), none.alias("third"), none.alias("setup")]
    distance = pairs.select(F.concat(F.lit("d"), F.col("a.station"), F.col("b.station")).alias("obs"), F.lit("HORIZONTAL_DISTANCE").alias("type"), F.sqrt(dx * dx + dy * dy).alias("value"), F.lit(1e-6).alias("variance"), *base)
    azimuth = pairs.select(F.concat(F.lit("z"), F.col("a.station"), F.col("b.station")).alias("obs"), F.lit("AZIMUTH").alias("type"), F.atan2(dx, dy).alias("value"), F.lit(1e-10).alias("variance"), *base)
    return true.select("network_id", "station", F.col("cx").alias("x"), F.col("cy").alias("y"), "z", "fixed"), distance.unionByName(azimuth)


@query("plane_networks", "SELECT 'q' || c_custkey AS network_id, s AS station, round(x + CASE WHEN f THEN 0 ELSE c_custkey % 17 / 10.0 END, 5)+0.0 AS x, round(y - CASE WHEN f THEN 0 ELSE c_custkey % 17 / 10.0 END, 5)+0.0 AS y FROM customer, (VALUES ('A',0.0,0.0,true),('B',100.0,0.0,true),('C',100.0,100.0,false),('D',0.0,100.0,false)) AS q(s,x,y,f)")
def plane_networks(spark, sf):
    """Many networks at once from displaced approximate coordinates: observations without errors give back the true ones."""
    stations, observations = _plane_networks(spark, sf)
    out = adjustment.adjust(stations, observations, "plane_2d")
    return out["stations"].select("network_id", "station", r(F.col("x"), 5).alias("x"), r(F.col("y"), 5).alias("y"))


@query("starting_positions", "SELECT 'q' || c_custkey AS network_id, s AS station, round(x + CASE WHEN f THEN 0 ELSE c_custkey % 17 / 10.0 END, 5)+0.0 AS x, round(y - CASE WHEN f THEN 0 ELSE c_custkey % 17 / 10.0 END, 5)+0.0 AS y FROM customer, (VALUES ('A',0.0,0.0,true),('B',100.0,0.0,true),('C',100.0,100.0,false),('D',0.0,100.0,false)) AS q(s,x,y,f)")
def starting_positions(spark, sf):
    """The same networks without approximate coordinates of their free corners; from one held corner alone, the others follow."""
    stations, observations = _plane_networks(spark, sf)
    bare = stations.withColumns({c: F.when(F.col("fixed"), F.col(c)) for c in "xy"})
    out = starting.starting_positions(bare, observations)
    return out.select("network_id", "station", r(F.col("x"), 5).alias("x"), r(F.col("y"), 5).alias("y"))


@query("carried_values", """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM events)
SELECT CAST(user_id AS VARCHAR) AS network_id, k AS station, round(100 + sum(CASE WHEN k = 1 THEN 0 ELSE value END) OVER (PARTITION BY user_id ORDER BY k), 4)+0.0 AS value FROM e
QUALIFY count(*) OVER (PARTITION BY user_id) > 1""")
def carried_values(spark, sf):
    """A line a user: each of its events is a station, a step in value from the one before; the first is held at 100."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("network_id"), F.row_number().over(order).cast("long").alias("b"), F.col("value").alias("d_value"))
    ties = e.where("b > 1").select("network_id", (F.col("b") - 1).alias("a"), "b", "d_value")
    seeds = ties.where("a = 1").select("network_id", F.col("a").alias("station"), F.lit(100.0).alias("value"))
    return network.carried_values(seeds, ties).select("network_id", "station", r(F.col("value"), 4).alias("value"))


@query("plane_design")
def plane_design(spark, sf):
    """Expected ellipses of the planned networks."""
    stations, observations = _plane_networks(spark, sf)
    out = adjustment.simulate(stations, observations, "plane_2d")
    e = adjustment.station_ellipses(out["cofactors"], dist.confidence_scale(0.95, 2))
    return e.select("network_id", "station", *(r(F.col(c), 9).alias(c) for c in ("semi_major", "semi_minor", "azimuth")))


YEARS = "SELECT station, epoch, x, y, z, vx, vy, vz FROM {epochs}"


def _two(spark, sf):
    e = epochs(spark, sf)
    return e.where("epoch = 1995.5"), e.where("epoch = 1996.5")


COMPARE = "SELECT a.station, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, (a.vx+b.vx)/1.5 AS qx, (a.vy+b.vy)/1.5 AS qy, (a.vz+b.vz)/1.5 AS qz FROM {epochs} a JOIN {epochs} b ON a.station = b.station WHERE a.epoch = 1995.5 AND b.epoch = 1996.5"


@query("epoch_comparison", "SELECT station, round(dx,6)+0.0 AS dx, round(dy,6)+0.0 AS dy, round(dz,6)+0.0 AS dz, round(qx,6)+0.0 AS qx, 1.5 AS pooled, 40 AS dof FROM (" + COMPARE + ")")
def epoch_comparison(spark, sf):
    c = monitoring.compare(*_two(spark, sf))
    return c.select("station", *(r(F.col(n)).alias(n) for n in ("dx", "dy", "dz", "qx")), "pooled", F.col("dof").cast("int").alias("dof"))


@query("epoch_unmatched", "SELECT coalesce(a.station, b.station) AS station, CASE WHEN b.station IS NULL THEN 'first' ELSE 'second' END AS epoch FROM (SELECT station FROM {epochs} WHERE epoch = 1995.5) a FULL JOIN (SELECT station FROM {epochs} WHERE epoch = 1996.5 AND y > 4.7) b ON a.station = b.station WHERE a.station IS NULL OR b.station IS NULL")
def epoch_unmatched(spark, sf):
    first, second = _two(spark, sf)
    return monitoring.unmatched(first, second.where("y > 4.7"))


@query("epoch_reference", "SELECT station, round(dx-avg(CASE WHEN station < 'N2' THEN dx END) OVER (),6)+0.0 AS dx, round(dy-avg(CASE WHEN station < 'N2' THEN dy END) OVER (),6)+0.0 AS dy, round(dz-avg(CASE WHEN station < 'N2' THEN dz END) OVER (),6)+0.0 AS dz FROM (" + COMPARE + ")")
def epoch_reference(spark, sf):
    c = monitoring.compare(*_two(spark, sf)).withColumns({"is_reference": F.col("station") < "N2", "campaign": F.lit(1)})
    return monitoring.to_reference(c, ["campaign"]).select("station", *(r(F.col(n)).alias(n) for n in ("dx", "dy", "dz")))


@query("congruency", "SELECT round(sum(dx*dx/qx+dy*dy/qy+dz*dz/qz),4)+0.0 AS omega, 3*count(*) AS h FROM (" + COMPARE + ")")
def congruency(spark, sf):
    c = monitoring.compare(*_two(spark, sf)).withColumn("campaign", F.lit(1))
    return monitoring.congruency(c, ["campaign"]).select(r(F.col("omega"), 4).alias("omega"), "h")


@query("unstable_reference")
def unstable_reference(spark, sf):
    c = monitoring.compare(*_two(spark, sf)).withColumn("campaign", F.lit(1))
    u = monitoring.unstable_reference(c, ["campaign"])
    return u.select("campaign", "step", "station", *(r(F.col(n), 4).alias(n) for n in ("share", "statistic", "critical")))


@query("displacements", "SELECT station, round(sqrt(dx*dx+dy*dy),6)+0.0 AS horizontal, round(sqrt(dx*dx+dy*dy+dz*dz),6)+0.0 AS magnitude, round((dx*dx/qx+dy*dy/qy+dz*dz/qz)/1.5,4)+0.0 AS statistic, (dx*dx/qx+dy*dy/qy+dz*dz/qz)/1.5 > 7.81 AS significant FROM (" + COMPARE + ")")
def displacements(spark, sf):
    d = monitoring.displacements(monitoring.compare(*_two(spark, sf)), 7.81)
    return d.select("station", r(F.col("horizontal")).alias("horizontal"), r(F.col("magnitude")).alias("magnitude"), r(F.col("statistic"), 4).alias("statistic"), "significant")


@query("time_series", "SELECT station, epoch, round(x-first_value(x) OVER w,6)+0.0 AS ox, round(y-first_value(y) OVER w,6)+0.0 AS oy, round(z-first_value(z) OVER w,6)+0.0 AS oz FROM {epochs} WINDOW w AS (PARTITION BY station ORDER BY epoch)")
def time_series(spark, sf):
    return monitoring.series(epochs(spark, sf)).select("station", "epoch", *(r(F.col(c)).alias(c) for c in ("ox", "oy", "oz")))


@query("velocities", """
WITH m AS (SELECT station, avg(epoch) AS t0, count(*) AS k FROM {epochs} GROUP BY station), s AS (SELECT e.station, any_value(k) AS k, sum(1/vx) AS w, sum((epoch-t0)/vx) AS s1, sum((epoch-t0)*(epoch-t0)/vx) AS s2, sum(x/vx) AS l, sum((epoch-t0)*x/vx) AS sl FROM {epochs} e JOIN m ON e.station = m.station GROUP BY e.station)
SELECT station, k AS epochs, round(CASE WHEN k > 1 THEN (w*sl-s1*l)/(w*s2-s1*s1) END,6)+0.0 AS velocity_x, round(CASE WHEN k > 1 THEN w/(w*s2-s1*s1) END,6)+0.0 AS velocity_x_variance FROM s""")
def velocities(spark, sf):
    return monitoring.velocities(epochs(spark, sf)).select("station", "epochs", r(F.col("velocity_x")).alias("velocity_x"), r(F.col("velocity_x_variance")).alias("velocity_x_variance"))


def _blocks(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select((k % 20).alias("block"), (k % 97 * 10.0).alias("x"), (k % 89 * 10.0).alias("y"), (1e-4 * (k % 97) + 2e-4 * (k % 89)).alias("dx"), (3e-4 * (k % 97) - 1e-4 * (k % 89)).alias("dy"))


@query("strain", "SELECT DISTINCT CAST(c_custkey % 20 AS BIGINT) AS block, round(5e-6,9) AS rotation, 0.0 AS dilatation, round(sqrt(2e-5*2e-5+5e-5*5e-5),9)+0.0 AS shear FROM customer")
def strain(spark, sf):
    s = monitoring.strain(_blocks(spark, sf), ["block"])
    return s.select(F.col("block").cast("long").alias("block"), r(F.col("rotation"), 9).alias("rotation"), r(F.col("dilatation"), 9).alias("dilatation"), r(F.col("shear"), 9).alias("shear"))


ALERTS = "SELECT t.id AS threshold, d.station, t.kind, v FROM (VALUES ('a','magnitude',0.5),('b','horizontal',0.4),('c','vertical',0.2)) AS t(id, kind, lim), (SELECT station, sqrt(dx*dx+dy*dy+dz*dz) AS m, sqrt(dx*dx+dy*dy) AS h, abs(dz) AS z, (dx*dx/qx+dy*dy/qy+dz*dz/qz)/1.5 > 7.81 AS sig FROM (" + COMPARE + ")) d, LATERAL (SELECT CASE t.kind WHEN 'magnitude' THEN m WHEN 'horizontal' THEN h ELSE z END AS v) x WHERE v > t.lim"


def _alerts(spark, sf):
    moved = monitoring.displacements(monitoring.compare(*_two(spark, sf)), 7.81)
    thresholds = spark.createDataFrame([("a", "magnitude", 0.5, None), ("b", "horizontal", 0.4, None), ("c", "vertical", 0.2, None)], "threshold string, kind string, limit double, stations array<string>")
    return moved, monitoring.alerts(thresholds, moved)


@query("alerts", f"SELECT threshold, station, kind, round(v,6)+0.0 AS value FROM ({ALERTS})")
def alerts(spark, sf):
    return _alerts(spark, sf)[1].select("threshold", "station", "kind", r(F.col("value")).alias("value"))


@query("station_categories", f"SELECT c.station, CASE WHEN k IS NOT NULL THEN 'alert' WHEN (dx*dx/qx+dy*dy/qy+dz*dz/qz)/1.5 > 7.81 THEN 'significant' ELSE 'none' END AS category FROM ({COMPARE}) c LEFT JOIN (SELECT station, count(*) AS k FROM ({ALERTS}) GROUP BY station) a ON a.station = c.station")
def station_categories(spark, sf):
    moved, crossed = _alerts(spark, sf)
    return monitoring.station_category(moved, crossed).select("station", "category")


@query("variance_components")
def variance_components(spark, sf):
    stations, observations = _height_network(spark, sf)
    grouped = observations.withColumn("technique", F.when(F.col("at") < F.col("to"), "forward").otherwise("back"))
    found = adjustment.variance_components(stations, grouped, "height_1d", "technique")
    return found.select("technique", r(F.col("factor"), 3).alias("factor"), r(F.col("std_dev"), 3).alias("std_dev"), r(F.col("redundancy"), 3).alias("redundancy"), "observations")
