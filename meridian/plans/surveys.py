"""Queries of survey reductions: gravimetry, levelling, GNSS, total station, networks as graphs, tables of results."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meridian.operators import gnss, gravimetry, levelling, network, store, total_station
from meridian.plans.registry import edges, points, query, r, readings, setups, table

VISITS = """SELECT session, visit, station, sum(value/variance)/sum(1/variance) AS value, 1/sum(1/variance) AS variance, sum(epoch_us(instant)/1e6/variance)/sum(1/variance) AS seconds, count(*) AS readings
FROM (SELECT *, sum(change) OVER (PARTITION BY session ORDER BY instant, event_id ROWS UNBOUNDED PRECEDING) AS visit
 FROM (SELECT *, CASE WHEN lag(station) OVER (PARTITION BY session ORDER BY instant, event_id) = station THEN 0 ELSE 1 END AS change FROM {readings})) GROUP BY session, visit, station"""
ORDER = ["instant", "event_id"]


@query("gravity_occupations", f"SELECT session, visit, station, round(value,6)+0.0 AS value, round(variance,9)+0.0 AS variance, round(seconds,3)+0.0 AS seconds, readings FROM ({VISITS})")
def gravity_occupations(spark, sf):
    v = gravimetry.occupations(readings(spark, sf), ORDER)
    return v.select("session", "visit", "station", r(F.col("value")).alias("value"), r(F.col("variance"), 9).alias("variance"), r(F.col("seconds"), 3).alias("seconds"), "readings")


@query("gravity_differences", f'SELECT session, visit, station AS "from", "to", round(d,6)+0.0 AS difference, round(v,9)+0.0 AS variance, round(elapsed,3)+0.0 AS elapsed FROM (SELECT *, lead(station) OVER w AS "to", lead(value) OVER w - value AS d, lead(variance) OVER w + variance AS v, lead(seconds) OVER w - seconds AS elapsed FROM ({VISITS}) WINDOW w AS (PARTITION BY session ORDER BY visit)) WHERE "to" IS NOT NULL')
def gravity_differences(spark, sf):
    d = gravimetry.successive_differences(gravimetry.occupations(readings(spark, sf), ORDER))
    return d.select("session", "visit", "from", "to", r(F.col("difference")).alias("difference"), r(F.col("variance"), 9).alias("variance"), r(F.col("elapsed_to") - F.col("elapsed_from"), 3).alias("elapsed"))


BASE = f"SELECT *, min(seconds) OVER (PARTITION BY session) AS start FROM ({VISITS}) WHERE station = 'view'"
LINE = f"SELECT session, count(*) AS base_visits, any_value(start) AS start, sum(1/variance) AS w, sum((seconds-start)/variance) AS wx, sum(value/variance) AS wy, sum((seconds-start)*(seconds-start)/variance) AS wxx, sum((seconds-start)*value/variance) AS wxy FROM ({BASE}) GROUP BY session"
DRIFT = f"SELECT session, base_visits, start, CASE WHEN w*wxx-wx*wx > 0 THEN (w*wxy-wx*wy)/(w*wxx-wx*wx) END AS rate, (wy-(CASE WHEN w*wxx-wx*wx > 0 THEN (w*wxy-wx*wy)/(w*wxx-wx*wx) END)*wx)/w AS off FROM ({LINE})"


@query("gravity_drift", f"SELECT session, base_visits, round(rate*86400,4)+0.0 AS per_day, round(off,4)+0.0 AS base FROM ({DRIFT})")
def gravity_drift(spark, sf):
    d = gravimetry.base_drift(gravimetry.occupations(readings(spark, sf), ORDER), F.col("station") == "view")
    return d.select("session", "base_visits", r(F.col("rate") * 86400, 4).alias("per_day"), r(F.col("offset"), 4).alias("base"))


@query("gravity_precorrected", f"SELECT v.session, visit, station, round(value-(off+rate*(seconds-start)),4)+0.0 AS difference FROM ({VISITS}) v JOIN ({DRIFT}) d ON v.session = d.session WHERE station <> 'view'")
def gravity_precorrected(spark, sf):
    d = gravimetry.precorrected(gravimetry.occupations(readings(spark, sf), ORDER), F.col("station") == "view")
    return d.select("session", "visit", "station", r(F.col("difference"), 4).alias("difference"))


@query("gravity_calibration", """
WITH t AS (SELECT CAST(p_size AS DOUBLE) AS counter, min(p_retailprice) AS gravity, avg(p_retailprice)/1000 AS factor FROM part GROUP BY p_size), m AS (SELECT max(counter) AS last FROM t), l AS (SELECT last + last - (SELECT max(counter) FROM t WHERE counter < last) AS stop FROM m)
SELECT event_id, round(CASE WHEN c <= (SELECT stop FROM l) THEN t.gravity + (c - t.counter)*t.factor END, 9)+0.0 AS value FROM (SELECT event_id, event_id % 601 / 10.0 AS c FROM events) e ASOF LEFT JOIN t ON e.c >= t.counter""")
def gravity_calibration(spark, sf):
    t = table(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("counter")).agg(F.min("p_retailprice").alias("gravity"), (F.avg("p_retailprice") / 1000).alias("factor")).withColumn("instrument", F.lit("g1"))
    asked = table(spark, sf, "events").select("event_id", F.lit("g1").alias("instrument"), (F.col("event_id") % 601 / 10.0).alias("counter"))
    return gravimetry.calibrated(asked, t).select("event_id", r(F.col("value"), 9).alias("value"))


@query("gravity_duplicates", "SELECT session, station, n FROM (SELECT session, station, instant, count(*) AS n FROM (SELECT * FROM {readings} UNION ALL SELECT * FROM {readings} WHERE event_id % 50 = 0) GROUP BY ALL HAVING count(*) > 1)")
def gravity_duplicates(spark, sf):
    """Every fiftieth reading is there twice."""
    rows = readings(spark, sf)
    return gravimetry.duplicate_readings(rows.unionByName(rows.where("event_id % 50 = 0"))).select("session", "station", "n")


@query("level_setups", 'SELECT line, seq, round(backsight_distance-foresight_distance,6)+0.0 AS imbalance, round(backsight-foresight-1e-4*(backsight_distance-foresight_distance),6)+0.0 AS height_difference, round(5e-6+1e-10*(backsight_distance-foresight_distance)*(backsight_distance-foresight_distance),12)+0.0 AS variance, greatest(backsight_distance,foresight_distance) > 25 AS long_sight, abs(backsight_distance-foresight_distance) > 3 AS unbalanced FROM {setups}')
def level_setups(spark, sf):
    s = levelling.reduce_setups(setups(spark, sf), 1e-4, 1e-10, 25.0, 3.0)
    return s.select("line", "seq", r(F.col("imbalance")).alias("imbalance"), r(F.col("height_difference")).alias("height_difference"), r(F.col("variance"), 12).alias("variance"), "long_sight", "unbalanced")


LINES = 'SELECT line, arg_min("from", seq) AS "from", arg_max("to", seq) AS "to", count(*) AS setups, sum(backsight-foresight)-1e-4*sum(backsight_distance-foresight_distance) AS height_difference, sum(backsight_distance-foresight_distance) AS imbalance, sum(backsight_distance+foresight_distance) AS length, sum(backsight_variance+foresight_variance)+sum(backsight_distance-foresight_distance)*sum(backsight_distance-foresight_distance)*1e-10 AS variance FROM {setups} GROUP BY line'


def _lines(spark, sf):
    return levelling.reduce_lines(setups(spark, sf), 1e-4, 1e-10)


@query("level_lines", f'SELECT line, "from", "to", setups, round(height_difference,6)+0.0 AS height_difference, round(imbalance,6)+0.0 AS imbalance, round(length,4)+0.0 AS length, round(variance,12)+0.0 AS variance FROM ({LINES})')
def level_lines(spark, sf):
    return _lines(spark, sf).select("line", "from", "to", "setups", r(F.col("height_difference")).alias("height_difference"), r(F.col("imbalance")).alias("imbalance"), r(F.col("length"), 4).alias("length"), r(F.col("variance"), 12).alias("variance"))


@query("level_discontinuities", 'SELECT line, seq, before, "from" FROM (SELECT line, seq, "from", lag("to") OVER (PARTITION BY line ORDER BY seq) AS before FROM {setups}) WHERE before <> "from"')
def level_discontinuities(spark, sf):
    return levelling.discontinuities(setups(spark, sf))


@query("level_sections", f'WITH l AS (SELECT *, least("from","to") AS a, greatest("from","to") AS b, CASE WHEN "from" <= "to" THEN height_difference ELSE -height_difference END AS dh FROM ({LINES})), w AS (SELECT *, row_number() OVER o AS run, first_value(dh) OVER o AS d1, first_value(length) OVER o AS l1 FROM l WINDOW o AS (PARTITION BY a, b ORDER BY line)) SELECT a, b, line, round(dh-d1,6)+0.0 AS discrepancy, round(least(length,l1),4)+0.0 AS length FROM w WHERE run > 1')
def level_sections(spark, sf):
    s = levelling.section_closures(_lines(spark, sf), 0.01)
    return s.select("a", "b", "line", r(F.col("discrepancy")).alias("discrepancy"), r(F.col("length"), 4).alias("length"))


@query("level_closures", f'SELECT line, round(height_difference-0.5,6)+0.0 AS misclosure, round(0.02*sqrt(length/1000),6)+0.0 AS permissible, setups AS weight FROM ({LINES}) WHERE "from" <> "to"')
def level_closures(spark, sf):
    lines = _lines(spark, sf)
    known = lines.where(F.col("from") != F.col("to")).select("from", "to").distinct().withColumns({"known": F.lit(0.5), "known_variance": F.lit(1e-6)})
    c = levelling.line_closures(lines, known, 0.02, "count")
    return c.select("line", r(F.col("misclosure")).alias("misclosure"), r(F.col("permissible")).alias("permissible"), "weight")


@query("level_distribution", f'SELECT s.line, s.seq, round(-(l.height_difference-0.5)*(s.backsight_distance+s.foresight_distance)/l.length,12)+0.0 AS correction FROM {{setups}} s JOIN ({LINES}) l ON s.line = l.line')
def level_distribution(spark, sf):
    s = setups(spark, sf)
    rows = s.join(_lines(spark, sf).select("line", (F.col("height_difference") - 0.5).alias("misclosure")), "line").withColumn("w", F.col("backsight_distance") + F.col("foresight_distance"))
    return levelling.distribute(rows, "line", "misclosure", "w").select("line", "seq", r(F.col("correction"), 12).alias("correction"))


@query("level_loops", f'SELECT line % 100 AS loop, round(sum(CASE WHEN line % 2 = 0 THEN height_difference ELSE -height_difference END),4)+0.0 AS misclosure, round(sum(variance),11)+0.0 AS variance, round(sum(length),3)+0.0 AS length FROM ({LINES}) GROUP BY line % 100')
def level_loops(spark, sf):
    legs = _lines(spark, sf).withColumns({"loop": F.col("line") % 100, "seq": F.col("line"), "sign": F.when(F.col("line") % 2 == 0, 1).otherwise(-1)})
    return levelling.loop_closures(legs, 0.02).select("loop", r(F.col("misclosure"), 4).alias("misclosure"), r(F.col("variance"), 11).alias("variance"), r(F.col("length"), 3).alias("length"))


@query("level_reciprocal", "SELECT p_partkey // 2 AS crossing, round((max(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END)+max(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice END))/2,6)+0.0 AS height_difference, round(max(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END)-max(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice END),6)+0.0 AS discrepancy FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey % 2) = 2")
def level_reciprocal(spark, sf):
    c = table(spark, sf, "part").select(F.expr("p_partkey div 2").alias("crossing"), (F.col("p_partkey") % 2 + 1).alias("bank"), F.col("p_retailprice").alias("height_difference"), F.lit(1.0).alias("variance"))
    return levelling.reciprocal(c).select("crossing", r(F.col("height_difference")).alias("height_difference"), r(F.col("discrepancy")).alias("discrepancy"))


@query("three_wire_readings", "SELECT p_partkey, round((3*m+0.3+p_size/100.0-0.29)/3,6)+0.0 AS reading, round((0.3+p_size/100.0-0.29)/2,6)+0.0 AS half_sum, round(100*(0.3+p_size/100.0+0.29),4)+0.0 AS distance FROM (SELECT p_partkey, p_size, p_retailprice/1000 AS m FROM part)")
def three_wire_readings(spark, sf):
    m = F.col("p_retailprice") / 1000
    w = levelling.three_wire(m + 0.3 + F.col("p_size") / 100.0, m, m - 0.29, F.lit(1e-6))
    return table(spark, sf, "part").select("p_partkey", r(w["reading"]).alias("reading"), r(w["half_sum"]).alias("half_sum"), r(w["distance"], 4).alias("distance"))


@query("setup_covariances", "WITH s AS (SELECT l_orderkey AS setup, l_linenumber AS target, max(l_tax)*100 AS imbalance FROM lineitem GROUP BY ALL) SELECT a.setup, a.target AS first, b.target AS second, round(1e6*(1e-6 + a.imbalance*b.imbalance*1e-8 + CASE WHEN a.target = b.target THEN 2e-6 ELSE 0 END),6)+0.0 AS covariance FROM s a JOIN s b ON a.setup = b.setup AND a.target <= b.target")
def setup_covariances(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("setup"), F.col("l_linenumber").alias("target")).agg((F.max("l_tax") * 100).alias("imbalance")).withColumns({"backsight_variance": F.lit(1e-6), "foresight_variance": F.lit(2e-6)})
    return levelling.foresight_covariances(s, 1e-8).select("setup", "first", "second", r(F.col("covariance") * 1e6).alias("covariance"))


SESSIONS = "SELECT user_id AS session, user_id % 5 AS station, min(ts) AS start, min(ts) + INTERVAL 2 DAY AS stop FROM events GROUP BY user_id"


def _sessions(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("start")).withColumns({"station": F.col("session") % 5, "end": F.col("start") + F.expr("INTERVAL 2 DAYS")})


@query("session_overlaps", f'SELECT session, station, sum(new) OVER (PARTITION BY station ORDER BY start, stop, session ROWS UNBOUNDED PRECEDING) AS "group" FROM (SELECT *, CASE WHEN max(stop) OVER (PARTITION BY station ORDER BY start, stop, session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start THEN 0 ELSE 1 END AS new FROM ({SESSIONS}))')
def session_overlaps(spark, sf):
    return gnss.overlap_groups(_sessions(spark, sf), ["station"]).select("session", "station", "group")


@query("session_occupations", f"SELECT session, station, sum(new) OVER (PARTITION BY station ORDER BY start, stop, session ROWS UNBOUNDED PRECEDING) AS occupation FROM (SELECT *, CASE WHEN (epoch_us(start)-epoch_us(lag(stop) OVER (PARTITION BY station ORDER BY start, stop, session)))/1e6 <= 60 THEN 0 ELSE 1 END AS new FROM ({SESSIONS}))")
def session_occupations(spark, sf):
    files = _sessions(spark, sf).withColumns({"setup": F.lit("a"), "interval": F.lit(15.0)})
    return gnss.occupations(files).select("session", "station", "occupation")


def _epochs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("session"), F.col("ts").alias("instant"), F.col("event_type").alias("status"), (F.col("event_id") % 12).alias("satellites"), F.col("value").alias("ratio"), "event_id")


@query("session_summary", "WITH e AS (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts))/1e6 AS gap FROM events) SELECT user_id AS session, count(*) AS epochs, round(avg(CASE WHEN event_type IN ('view','click') THEN 1.0 ELSE 0.0 END),6) AS fixed_fraction, min(event_id % 12) AS least_satellites, max(event_id % 12) AS most_satellites, max(value) AS best_ratio, round(median(value),6)+0.0 AS median_ratio, round(median(gap),3)+0.0 AS median_gap FROM e GROUP BY user_id")
def session_summary(spark, sf):
    s = gnss.session_summary(_epochs(spark, sf), ["view", "click"])
    return s.select("session", "epochs", r(F.col("fixed_fraction")).alias("fixed_fraction"), "least_satellites", "most_satellites", "best_ratio", r(F.col("median_ratio")).alias("median_ratio"), r(F.col("median_gap"), 3).alias("median_gap"))


@query("session_statuses", "SELECT user_id AS session, event_type AS status, count(*) AS epochs FROM events GROUP BY ALL")
def session_statuses(spark, sf):
    return gnss.status_counts(_epochs(spark, sf))


@query("session_days", f"SELECT DISTINCT CAST(unnest(generate_series(date_trunc('day', start), date_trunc('day', stop), INTERVAL 1 DAY)) AS DATE) AS day FROM ({SESSIONS})")
def session_days(spark, sf):
    return gnss.days_of(_sessions(spark, sf))


@query("dilution_of_precision")
def dilution_of_precision(spark, sf):
    e = table(spark, sf, "events")
    sight = e.select((F.col("event_id") % 2000).alias("session"), F.lit(0).alias("instant"), (F.col("user_id") * 0.7).alias("azimuth"), (0.1 + (F.col("event_id") % 14) / 10.0).alias("elevation"))
    d = gnss.dilution_of_precision(sight)
    return d.select("session", "satellites", *(r(F.col(c), 3).alias(c) for c in ("gdop", "pdop", "hdop", "vdop")))


BASELINES = "SELECT o_orderkey AS baseline, 'N' || (o_custkey % 7) AS base, 'N' || (o_orderkey % 7) AS rover, o_totalprice/1000 AS dx, (o_custkey % 101)/10.0 AS dy, (o_orderkey % 103)/10.0 AS dz FROM orders WHERE o_custkey % 7 <> o_orderkey % 7"


def _baselines(spark, sf):
    o = table(spark, sf, "orders").where("o_custkey % 7 <> o_orderkey % 7")
    name = lambda c: F.concat(F.lit("N"), (F.col(c) % 7).cast("string"))
    variances = {c: F.lit(1e-6 if c[1] == c[2] else 1e-7) for c in gnss.COVARIANCES}
    return o.select(F.col("o_orderkey").alias("baseline"), name("o_custkey").alias("base"), name("o_orderkey").alias("rover"), (F.col("o_totalprice") / 1000).alias("dx"), (F.col("o_custkey") % 101 / 10.0).alias("dy"), (F.col("o_orderkey") % 103 / 10.0).alias("dz")).withColumns(variances)


ORIENTED = f"SELECT baseline, least(base,rover) AS a, greatest(base,rover) AS b, CASE WHEN base <= rover THEN 1 ELSE -1 END AS s, dx, dy, dz FROM ({BASELINES})"


@query("baseline_repeatability", f"SELECT a, b, baseline, determinations, round(sx-mx,5)+0.0 AS departure_x, round(sy-my,5)+0.0 AS departure_y, round(sz-mz,5)+0.0 AS departure_z FROM (SELECT a, b, baseline, s*dx AS sx, s*dy AS sy, s*dz AS sz, count(*) OVER w AS determinations, avg(s*dx) OVER w AS mx, avg(s*dy) OVER w AS my, avg(s*dz) OVER w AS mz FROM ({ORIENTED}) WINDOW w AS (PARTITION BY a, b)) WHERE determinations > 1")
def baseline_repeatability(spark, sf):
    b = gnss.repeatability(_baselines(spark, sf))
    return b.select("a", "b", "baseline", "determinations", *(r(F.col(f"departure_{c}"), 5).alias(f"departure_{c}") for c in "xyz"))


@query("baseline_loops", f"SELECT baseline % 50 AS loop, round(sum(s*dx),4)+0.0 AS mx, round(sum(s*dy),4)+0.0 AS my, round(sum(s*dz),4)+0.0 AS mz, round(count(*)*1e-6,9)+0.0 AS cxx, round(sum(sqrt(dx*dx+dy*dy+dz*dz)),3)+0.0 AS perimeter FROM ({ORIENTED}) GROUP BY 1")
def baseline_loops(spark, sf):
    legs = _baselines(spark, sf).withColumns({"loop": F.col("baseline") % 50, "sign": F.when(F.col("base") <= F.col("rover"), 1).otherwise(-1)})
    return gnss.loop_closure(legs).select("loop", *(r(F.col(f"m{c}"), 4).alias(f"m{c}") for c in "xyz"), r(F.col("cxx"), 9).alias("cxx"), r(F.col("perimeter"), 3).alias("perimeter"))


@query("baseline_configurations", f"WITH b AS (SELECT base, rover, baseline % 3 AS configuration, avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz FROM ({BASELINES}) GROUP BY ALL) SELECT x.base, x.rover, x.configuration, round(x.dx-y.dx,5)+0.0 AS dx, round(x.dy-y.dy,5)+0.0 AS dy, round(x.dz-y.dz,5)+0.0 AS dz, round((x.dx-y.dx)*(x.dx-y.dx)/2+(x.dy-y.dy)*(x.dy-y.dy)/4+(x.dz-y.dz)*(x.dz-y.dz)/6,4)+0.0 AS chi2 FROM b x JOIN b y ON x.base = y.base AND x.rover = y.rover AND y.configuration = 0 WHERE x.configuration <> 0")
def baseline_configurations(spark, sf):
    b = _baselines(spark, sf).groupBy("base", "rover", (F.col("baseline") % 3).alias("configuration")).agg(*(F.avg(c).alias(c) for c in ("dx", "dy", "dz")))
    b = b.withColumns({"cxx": F.lit(1.0), "cyy": F.lit(2.0), "czz": F.lit(3.0), "cxy": F.lit(0.0), "cxz": F.lit(0.0), "cyz": F.lit(0.0)}).withColumn("configuration", F.col("configuration").cast("string"))
    c = gnss.compare_configurations(b, "0", 7.81)
    return c.select("base", "rover", F.col("configuration").cast("long").alias("configuration"), *(r(F.col(f"d{x}"), 5).alias(f"d{x}") for x in "xyz"), r(F.col("chi2"), 4).alias("chi2"))


def _pointings(spark, sf):
    p = points(spark, sf)
    d = p.select((F.col("point") % 40).alias("setup"), F.col("point").alias("target"), F.lit(1).alias("set"), F.lit("D").alias("face"), (F.col("longitude") + math.pi).alias("horizontal"), (1.5 + F.col("latitude") / 10).alias("zenith"), (100 + F.col("height") / 10).alias("distance"), F.lit(1).alias("row"))
    reverse = d.withColumns({"face": F.lit("R"), "horizontal": F.pmod(F.col("horizontal") + math.pi + 2e-5 * (F.col("target") % 5), F.lit(2 * math.pi)), "zenith": 2 * math.pi - F.col("zenith") + 1e-5, "distance": F.col("distance") + 0.002})
    again = d.withColumns({"horizontal": F.col("horizontal") + 1, "row": F.lit(2)})
    return d.unionByName(reverse).unionByName(again)


@query("face_pairs", "SELECT point % 40 AS setup, point AS target, round(-1e-5*(point % 5),9)+0.0 AS collimation, round(5e-6,9)+0.0 AS vertical_index, round(1.5+latitude/10-5e-6,9)+0.0 AS zenith, round(100.001+height/10,6)+0.0 AS distance FROM {points}")
def face_pairs(spark, sf):
    pairs = total_station.reduce_face_pairs(total_station.face_pairs(total_station.first_pointings(_pointings(spark, sf))))
    return pairs.select("setup", "target", r(F.col("collimation"), 9).alias("collimation"), r(F.col("vertical_index"), 9).alias("vertical_index"), r(F.col("zenith"), 9).alias("zenith"), r(F.col("distance")).alias("distance"))


@query("setup_diagnostics", "SELECT point % 40 AS setup, count(*) AS pairs, round(avg(-1e-5*(point % 5)),9)+0.0 AS collimation, round(1e-5*(max(point % 5)-min(point % 5)),9)+0.0 AS collimation_spread FROM {points} GROUP BY 1")
def setup_diagnostics(spark, sf):
    pairs = total_station.reduce_face_pairs(total_station.face_pairs(total_station.first_pointings(_pointings(spark, sf))))
    return total_station.setup_diagnostics(pairs).select("setup", "pairs", r(F.col("collimation"), 9).alias("collimation"), r(F.col("collimation_spread"), 9).alias("collimation_spread"))


@query("traverses", "WITH l AS (SELECT l_orderkey AS t, l_linenumber AS seq, max(l_quantity)/10 AS angle, max(l_extendedprice)/1000 AS d FROM lineitem GROUP BY ALL), a AS (SELECT *, 1.0 + sum(angle+pi()) OVER (PARTITION BY t ORDER BY seq ROWS UNBOUNDED PRECEDING) AS az FROM l), p AS (SELECT *, 10 + sum(d*sin(az)) OVER w AS x0, 20 + sum(d*cos(az)) OVER w AS y0, sum(d) OVER w AS run, sum(d) OVER (PARTITION BY t) AS per, sum(d*sin(az)) OVER (PARTITION BY t) AS mx, sum(d*cos(az)) OVER (PARTITION BY t) AS my FROM a WINDOW w AS (PARTITION BY t ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT t AS traverse, seq, round(x0-mx*run/per,5)+0.0 AS x, round(y0-my*run/per,5)+0.0 AS y, round(sqrt(mx*mx+my*my),5)+0.0 AS misclosure FROM p")
def traverses(spark, sf):
    legs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("traverse"), F.col("l_linenumber").alias("seq")).agg((F.max("l_quantity") / 10).alias("angle"), (F.max("l_extendedprice") / 1000).alias("distance"))
    legs = legs.withColumns({"start_azimuth": F.lit(1.0), "start_x": F.lit(10.0), "start_y": F.lit(20.0), "close_azimuth": F.lit(None).cast("double"), "close_x": F.lit(10.0), "close_y": F.lit(20.0)})
    return total_station.traverse(legs).select("traverse", "seq", r(F.col("x"), 5).alias("x"), r(F.col("y"), 5).alias("y"), r(F.col("misclosure"), 5).alias("misclosure"))


@query("radiation", "SELECT point, round(100+d*sin(z)*sin(longitude+0.5),6)+0.0 AS x, round(200+d*sin(z)*cos(longitude+0.5),6)+0.0 AS y, round(50+1.5+d*cos(z)-1.7,6)+0.0 AS z FROM (SELECT point, longitude, 100+height/10 AS d, 1.5+latitude/10 AS z FROM {points})")
def radiation(spark, sf):
    s = points(spark, sf).select("point", F.col("longitude").alias("horizontal"), (1.5 + F.col("latitude") / 10).alias("zenith"), (100 + F.col("height") / 10).alias("distance"), F.lit(100.0).alias("station_x"), F.lit(200.0).alias("station_y"), F.lit(50.0).alias("station_z"), F.lit(0.5).alias("orientation"), F.lit(1.5).alias("instrument_height"), F.lit(1.7).alias("target_height"))
    return total_station.radiate(s).select("point", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), r(F.col("z")).alias("z"))


@query("leapfrog_levelling", "SELECT point, round((d*cos(z+0.1)-d*cos(z))+0.87*((d*sin(z+0.1))*(d*sin(z+0.1))-(d*sin(z))*(d*sin(z)))/(2*6371000.0)-(1.6-1.5),6)+0.0 AS height_difference FROM (SELECT point, 100+height/10 AS d, 1.4+latitude/10 AS z FROM {points})")
def leapfrog_levelling(spark, sf):
    p = points(spark, sf).select(F.col("point").alias("setup"), (100 + F.col("height") / 10).alias("distance"), (1.4 + F.col("latitude") / 10).alias("zenith"))
    b = p.withColumns({"direction": F.lit("B"), "target_height": F.lit(1.5)})
    f = p.withColumns({"direction": F.lit("F"), "zenith": F.col("zenith") + 0.1, "target_height": F.lit(1.6)})
    return total_station.leapfrog(b.unionByName(f)).select(F.col("setup").alias("point"), r(F.col("height_difference")).alias("height_difference"))


@query("intersections", "SELECT point AS target, 3 AS rays, round(longitude*100,4)+0.0 AS x, round(300+height/10,4)+0.0 AS y FROM {points}")
def intersections(spark, sf):
    p = points(spark, sf).select(F.col("point").alias("target"), (F.col("longitude") * 100).alias("tx"), (300 + F.col("height") / 10).alias("ty"))
    stations = spark.createDataFrame([(0.0, 0.0), (1000.0, -50.0), (-800.0, 20.0)], "x double, y double")
    s = p.join(F.broadcast(stations)).withColumns({"azimuth": F.atan2(F.col("tx") - F.col("x"), F.col("ty") - F.col("y")), "variance": F.lit(1e-10)})
    return total_station.intersections(s).select("target", F.col("rays").cast("int").alias("rays"), r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"))


def _observations(spark, sf):
    e = edges(spark, sf)
    return e.select("network_id", F.concat_ws("-", "a", "b").alias("observation"), F.lit("HEIGHT_DIFFERENCE").alias("type"), F.array(F.col("a").cast("string"), F.col("b").cast("string")).alias("stations"), F.when(F.col("n") % 7 == 0, "REJECTED").otherwise("ACTIVE").alias("status"))


@query("active_observations", "SELECT a || '-' || b AS observation FROM {edges} WHERE n % 7 <> 0")
def active_observations(spark, sf):
    return network.active_observations(_observations(spark, sf)).select("observation")


@query("observed_pairs", "SELECT DISTINCT least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS a, greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS b FROM {edges} WHERE n % 7 <> 0")
def observed_pairs(spark, sf):
    return network.observed_pairs(_observations(spark, sf)).select("a", "b")


@query("duplicate_observations", "SELECT 'HEIGHT_DIFFERENCE:' || a || '-' || b || ':2' AS subject FROM {edges} WHERE n % 7 <> 0")
def duplicate_observations(spark, sf):
    o = _observations(spark, sf)
    return network.duplicate_observations(o.unionByName(o)).select("subject")


@query("dangling_references", "SELECT a || '-' || b || ':' || x AS subject FROM (SELECT a, b, a AS x FROM {edges} UNION ALL SELECT a, b, b FROM {edges}) WHERE x IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def dangling_references(spark, sf):
    stations = table(spark, sf, "nation").where("n_regionkey <> 0").select(F.lit("n1").alias("network_id"), F.col("n_nationkey").cast("string").alias("station"))
    return network.dangling_references(stations, _observations(spark, sf)).select("subject")


def _chains(spark, sf):
    """Customers as stations; each is tied to the one before it, ten to a chain."""
    c = table(spark, sf, "customer")
    stations = c.select(F.lit("n1").alias("network_id"), F.col("c_custkey").alias("station"))
    ties = c.where("c_custkey % 10 > 0").select(F.lit("n1").alias("network_id"), F.col("c_custkey").alias("a"), (F.col("c_custkey") - 1).alias("b"))
    return stations, ties.join(stations.select(F.col("station").alias("b")), "b", "left_semi").select("network_id", "a", "b")


@query("under_observed_stations", "SELECT CAST(c.c_custkey AS VARCHAR) AS subject FROM customer c WHERE (CASE WHEN c_custkey % 10 > 0 AND c_custkey - 1 IN (SELECT c_custkey FROM customer) THEN 1 ELSE 0 END) + (CASE WHEN (c_custkey + 1) % 10 > 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer) THEN 1 ELSE 0 END) = 1")
def under_observed_stations(spark, sf):
    stations, ties = _chains(spark, sf)
    o = ties.select("network_id", F.col("a").cast("string").alias("observation"), F.lit("HORIZONTAL_DISTANCE").alias("type"), F.array(F.col("a").cast("string"), F.col("b").cast("string")).alias("stations"), F.lit("ACTIVE").alias("status"))
    own = stations.select("network_id", F.col("station").cast("string").alias("station"), F.lit(False).alias("fixed"))
    return network.under_observed(own, o, "plane_2d").select("subject")


@query("network_components", "SELECT c_custkey AS station, greatest(c_custkey - c_custkey % 10, (SELECT min(c_custkey) FROM customer)) AS component FROM customer")
def network_components(spark, sf):
    stations, ties = _chains(spark, sf)
    return network.connected_components(stations, ties).select("station", "component")


@query("approximate_heights", "SELECT c_custkey AS station, round(100.0 + (c_custkey % 10)*0.5, 6) AS value, CAST(CASE WHEN c_custkey BETWEEN 1 AND 9 THEN c_custkey - 1 ELSE c_custkey % 10 END AS INTEGER) AS depth FROM customer")
def approximate_heights(spark, sf):
    stations, ties = _chains(spark, sf)
    seeds = stations.where("station % 10 = 0 or station = 1").select("network_id", "station", (100.0 + 0.5 * (F.col("station") % 10)).alias("value"))
    return network.approximate_values(seeds, ties.withColumn("difference", F.lit(-0.5))).select("station", r(F.col("value")).alias("value"), "depth")


@query("store_upsert", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def store_upsert(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return store.upsert(s, s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"])


@query("store_differences", "SELECT s_suppkey, 's_acctbal' AS column_name FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal <> 0")
def store_differences(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changed = s.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(F.col("s_acctbal")))
    return store.differences(s, changed, ["s_suppkey"]).select("s_suppkey", "column_name")


@query("store_delete", "SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders) AS deleted FROM customer")
def store_delete(spark, sf):
    c = table(spark, sf, "customer")
    kept, _ = store.delete_unreferenced(c, c, table(spark, sf, "orders"), "c_custkey", "o_custkey")
    return c.select("c_custkey").join(kept.select("c_custkey", F.lit(True).alias("kept")), "c_custkey", "left").select("c_custkey", F.col("kept").isNull().alias("deleted"))


@query("store_supersede", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 AND (o_orderkey + 1) IN (SELECT o_orderkey FROM orders) THEN o_orderkey + 1 END AS superseded_by FROM orders")
def store_supersede(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.lit(None).cast("long").alias("superseded_by"))
    pairs = o.where("o_orderkey % 5 = 1").select(F.col("o_orderkey").alias("old"), (F.col("o_orderkey") + 1).alias("new"))
    return store.supersede(o, pairs, "o_orderkey")


@query("store_profiles", "SELECT s_suppkey, CASE WHEN s_suppkey <= 50 THEN 'kept' ELSE 'added' END AS outcome FROM supplier")
def store_profiles(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return store.insert_absent(s.where("s_suppkey <= 50"), s, ["s_suppkey"]).select("s_suppkey", "outcome")


@query("quantile_classes", "SELECT DISTINCT round(b, 4) AS bound FROM (SELECT unnest(quantile_cont(s_acctbal, [0.0,0.25,0.5,0.75,1.0])) AS b FROM supplier)")
def quantile_classes(spark, sf):
    s = table(spark, sf, "supplier").agg(F.percentile("s_acctbal", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("b"))
    return s.select(F.explode("b").alias("b")).select(r(F.col("b"), 4).alias("bound")).distinct()


@query("row_runs", "SELECT first_row, last_row FROM (SELECT min(event_id) AS first_row, max(event_id) AS last_row FROM (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS island FROM events WHERE event_type <> 'purchase') GROUP BY island)")
def row_runs(spark, sf):
    kept = table(spark, sf, "events").where("event_type <> 'purchase'")
    return store.row_runs(kept, "event_id")
