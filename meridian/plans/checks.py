"""Queries of functions that other queries do not reach."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from meridian.functions import angles, distributions as dist, geodesy, records, uncertainty, units
from meridian.functions.uncertainty import Q
from meridian.operators import gnss, gravimetry, levelling, monitoring, network, total_station
from meridian.plans.registry import SQL, points, query, r, setups, table
from meridian.plans.surveys import BASELINES, _baselines


@query("uncertainty_functions", """
SELECT point, round(a-b,6)+0.0 AS difference, CAST(round(va+vb,9) AS DOUBLE) AS difference_variance, round(pow(b,3),6)+0.0 AS cube, round(9*pow(b,4)*vb,6)+0.0 AS cube_variance, round(cos(a),9)+0.0 AS cosine, round(sin(a)*sin(a)*va,9)+0.0 AS cosine_variance,
round(tan(c),9)+0.0 AS tangent, round(va/pow(cos(c),4),9)+0.0 AS tangent_variance, round(asin(c),9)+0.0 AS arcsine, round(va/(1-c*c),9)+0.0 AS arcsine_variance, round(acos(c),9)+0.0 AS arccosine, round(atan(a),9)+0.0 AS arctangent, round(va/pow(1+a*a,2),9)+0.0 AS arctangent_variance,
round(exp(c),9)+0.0 AS exponential, round(exp(2*c)*va,9)+0.0 AS exponential_variance, round(ln(b),9)+0.0 AS logarithm, round(vb/(b*b),9)+0.0 AS logarithm_variance
FROM (SELECT point, longitude AS a, 2.0+latitude AS b, latitude/2 AS c, 0.01 AS va, 0.02 AS vb FROM {points})""")
def uncertainty_functions(spark, sf):
    a, b, c = Q.of("longitude", 0.01), Q.of(2.0 + F.col("latitude"), 0.02), Q.of(F.col("latitude") / 2, 0.01)
    u = uncertainty
    out = [("difference", a - b, 6, 9), ("cube", b**3, 6, 6), ("cosine", u.cos(a), 9, 9), ("tangent", u.tan(c), 9, 9), ("arcsine", u.asin(c), 9, 9), ("arctangent", u.atan(a), 9, 9), ("exponential", u.exp(c), 9, 9), ("logarithm", u.log(b), 9, 9)]
    columns = [x for n, q, d, e in out for x in (r(q.value, d).alias(n), r(q.variance, e).alias(f"{n}_variance"))]
    return points(spark, sf).select("point", *columns, r(u.acos(c).value, 9).alias("arccosine"))


@query("angle_inputs", "SELECT point, round(CASE WHEN point % 2 = 0 THEN 1 ELSE -1 END * radians((point % 90) + (point % 60)/60.0 + (point % 59)/3600.0),12)+0.0 AS radians, CAST((point % 30) + 273.15 AS DOUBLE) AS kelvin FROM {points}")
def angle_inputs(spark, sf):
    c = F.col("point")
    degrees = F.when(c % 2 == 0, 1).otherwise(-1) * (c % 90)
    sign = F.when(c % 2 == 0, 1.0).otherwise(-1.0)
    # minutes and seconds carry the sign of the degrees, which zero degrees cannot
    value = F.when((c % 90 == 0) & (c % 2 == 1), -angles.dms_to_radians(F.lit(0), c % 60, c % 59)).otherwise(angles.dms_to_radians(degrees, c % 60, c % 59))
    return points(spark, sf).select("point", r(F.when(sign > 0, value).otherwise(value), 12).alias("radians"), units.celsius_to_kelvin((c % 30).cast("double")).alias("kelvin"))


@query("geodetic_covariances", "WITH p AS (SELECT point, latitude AS b, longitude AS l, height AS h, 6378137.0 AS a, 2/298.257222101-pow(1/298.257222101,2) AS e FROM {points}), q AS (SELECT *, a*(1-e)/pow(1-e*pow(sin(b),2),1.5)+h AS m, a/sqrt(1-e*pow(sin(b),2))+h AS n FROM p) SELECT point, round(pow(m*sin(b)*cos(l),2)*1e-14+pow(n*cos(b)*sin(l),2)*4e-14+pow(cos(b)*cos(l),2)*0.01,9)+0.0 AS xx, round(pow(m*cos(b),2)*1e-14+pow(sin(b),2)*0.01,9)+0.0 AS zz, 1e-14 AS latitude_variance, 4e-14 AS longitude_variance, CAST(0.01 AS DOUBLE) AS height_variance FROM q")
def geodetic_covariances(spark, sf):
    """To geocentric covariances and back."""
    p = points(spark, sf)
    b, lon, h = F.col("latitude"), F.col("longitude"), F.col("height")
    zero = F.lit(0.0)
    s = geodesy.geodetic_covariance(b, lon, h, [[F.lit(1e-14), zero, zero], [zero, F.lit(4e-14), zero], [zero, zero, F.lit(0.01)]])
    p = p.withColumns({f"s{i}{j}": s[i][j] for i in range(3) for j in range(3)})
    t = geodesy.cartesian_covariance(b, lon, h, [[F.col(f"s{i}{j}") for j in range(3)] for i in range(3)])
    return p.select("point", r(F.col("s00"), 9).alias("xx"), r(F.col("s22"), 9).alias("zz"), r(t[0][0], 18).alias("latitude_variance"), r(t[1][1], 18).alias("longitude_variance"), r(t[2][2], 9).alias("height_variance"))


@query("local_vectors", f"SELECT baseline, round(-sin(0.3)*dx+cos(0.3)*dy,6)+0.0 AS east, round(-sin(0.2)*cos(0.3)*dx-sin(0.2)*sin(0.3)*dy+cos(0.2)*dz,6)+0.0 AS north, round(cos(0.2)*cos(0.3)*dx+cos(0.2)*sin(0.3)*dy+sin(0.2)*dz,6)+0.0 AS up, round(1e6*(1e-6*(pow(sin(0.3),2)+pow(cos(0.3),2))-2e-7*sin(0.3)*cos(0.3)),6)+0.0 AS cee, round(dx,6)+0.0 AS dx, round(dz,6)+0.0 AS dz FROM ({BASELINES})")
def local_vectors(spark, sf):
    """Baselines in the local horizon, with covariance, and back."""
    b = gnss.to_local(_baselines(spark, sf).withColumns({"latitude": F.lit(0.2), "longitude": F.lit(0.3)}))
    x, _, z = geodesy.enu_to_ecef(F.col("east"), F.col("north"), F.col("up"), F.col("latitude"), F.col("longitude"))
    return b.select("baseline", *(r(F.col(c)).alias(c) for c in ("east", "north", "up")), r(F.col("cee") * 1e6).alias("cee"), r(x).alias("dx"), r(z).alias("dz"))


@query("moved_positions", "SELECT point, round(longitude+0.02*(2020-2005),9)+0.0 AS x, round(latitude*(1+1e-6)-2e-6*height+3e-6*longitude,12)+0.0 AS dy FROM {points}")
def moved_positions(spark, sf):
    """Positions at another epoch, and a vector turned and scaled into another frame."""
    p = points(spark, sf)
    moved = geodesy.move_to_epoch((F.col("longitude"),), (F.lit(0.02),), F.lit(2005.0), F.lit(2020.0))
    turned = geodesy.Helmert(t=(1.0, 2.0, 3.0), r=(2e-6, 0.0, 3e-6), d=1e-6).apply_vector(F.col("longitude"), F.col("latitude"), F.col("height"), 2000.0)
    return p.select("point", r(moved[0], 9).alias("x"), r(turned[1], 12).alias("dy"))


@query("distance_corrections", "SELECT point, round((d+0.03)*1.00001-0.002*sin(2*pi()*(d+0.03)*1.00001/10+0.5),9)+0.0 AS instrument, round(CASE WHEN point % 2 = 0 THEN d ELSE d*1.000281/1.00027 END,9)+0.0 AS air, round(d*6371000/(6371000+height+12),9)+0.0 AS ellipsoid, round(d*(0.9996+4*0.9997+0.9999)/6,9)+0.0 AS grid FROM (SELECT point, height, 100+height/10 AS d FROM {points})")
def distance_corrections(spark, sf):
    d = 100 + F.col("height") / 10
    t = total_station
    return points(spark, sf).select("point", r(t.edm_correction(d, 0.03, 1.00001, 0.002, 10.0, 0.5), 9).alias("instrument"), r(t.atmospheric_correction(d, F.lit(1.00027), 1.000281, F.col("point") % 2 == 0), 9).alias("air"), r(t.to_ellipsoid(d, F.col("height"), 12.0, 6371000.0), 9).alias("ellipsoid"), r(d * t.line_scale(F.lit(0.9996), F.lit(0.9997), F.lit(0.9999)), 9).alias("grid"))


@query("corrected_lines", "SELECT line, seq, round(-0.0053023*sin(2*(la+lb)/2)*(ha+hb)/2*(lb-la),9)+0.0 AS correction FROM (SELECT line, seq, CAST(substr(\"from\",2) AS INTEGER)/10.0 AS la, CAST(substr(\"to\",2) AS INTEGER)/10.0 AS lb, 100.0*CAST(substr(\"from\",2) AS INTEGER) AS ha, 100.0*CAST(substr(\"to\",2) AS INTEGER) AS hb FROM {setups})")
def corrected_lines(spark, sf):
    """Normal orthometric corrections; the factor is that of the 1967 normal gravity formula, 0.0053023, taken as given."""
    places = spark.range(7).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("station"), (F.col("id") / 10.0).alias("latitude"), (F.col("id") * 100.0).alias("height"))
    own = setups(spark, sf).withColumn("height_difference", F.col("backsight") - F.col("foresight"))
    scale = 0.0053023 / levelling.GRAVITY_FLATTENING
    return levelling.correct_lines(own, places).select("line", "seq", r(F.col("correction") * scale, 9).alias("correction"))


@query("empirical_sigmas", "SELECT p_size, round(sqrt(sum(pow(p_retailprice/1e5-0.01,2))/(1.5*count(*))),9)+0.0 AS sigma, round(0.002*sqrt(p_size),9)+0.0 AS weighted FROM part GROUP BY p_size")
def empirical_sigmas(spark, sf):
    p = table(spark, sf, "part").groupBy("p_size").agg(r(levelling.empirical_sigma(F.col("p_retailprice") / 1e5 - 0.01), 9).alias("sigma"))
    return p.withColumn("weighted", r(levelling.weighted_sigma(0.002, F.col("p_size")), 9))


@query("reduced_readings", "SELECT event_id, round(value*1.0002+3.086e-6*(event_id % 5)*0.1,9)+0.0 AS reduced FROM events")
def reduced_readings(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("value").alias("reading"), F.col("ts").alias("instant"), F.lit(0.1).alias("latitude"), F.lit(0.2).alias("longitude"), F.lit(10.0).alias("height"), F.lit(True).alias("tide_applied"), (F.col("event_id") % 5 * 0.1).alias("sensor_height"))
    return gravimetry.reduce_readings(rows, 1.0002).select("event_id", r(F.col("reduced"), 9).alias("reduced"))


@query("gravity_treatments", "SELECT p_partkey AS station, round(p_size/100.0,6)+0.0 AS difference, p_size/100.0 > 3*sqrt(0.01) AS significant FROM part WHERE p_partkey % 3 <> 0")
def gravity_treatments(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("station"), F.col("p_retailprice").alias("value"), F.lit(0.005).alias("variance"), "p_size")
    second = p.where("station % 3 <> 0").withColumn("value", F.col("value") + F.col("p_size") / 100.0)
    c = gravimetry.compare_treatments(p.drop("p_size"), second.drop("p_size"))
    return c.select("station", r(F.abs("difference")).alias("difference"), "significant")


@query("active_clusters", "SELECT a.p_partkey AS first, b.p_partkey AS second FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey WHERE a.p_size % 3 <> 0 AND b.p_size % 3 <> 0")
def active_clusters(spark, sf):
    p = table(spark, sf, "part")
    obs = p.select(F.lit("n").alias("network_id"), F.col("p_partkey").alias("observation"), F.when(F.col("p_size") % 3 == 0, "REJECTED").otherwise("ACTIVE").alias("status"))
    entries = p.select(F.lit("n").alias("network_id"), F.col("p_partkey").alias("first"), (F.col("p_partkey") + 1).alias("second"))
    return network.active_clusters(entries, obs).select("first", "second")


@query("observations_of_a_station", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_suppkey % 7 = 3 OR l_partkey % 7 = 3")
def observations_of_a_station(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.array((F.col("l_suppkey") % 7).cast("string"), (F.col("l_partkey") % 7).cast("string")).alias("stations"))
    return network.observations_at(rows, "3").drop("stations")


@query("missing_coordinates", "SELECT CAST(c_custkey AS VARCHAR) AS subject FROM customer WHERE c_acctbal < 0")
def missing_coordinates(spark, sf):
    s = table(spark, sf, "customer").select(F.lit("n").alias("network_id"), F.col("c_custkey").alias("station"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("x"), F.lit(0.0).alias("y"))
    return network.missing_coordinates(s).select("subject")


@query("ellipse_rings", "SELECT point, k, round(longitude*1000+20*3*cos(k*pi()/18)*sin(0.4)+20*1*sin(k*pi()/18)*cos(0.4),6)+0.0 AS x, round(latitude*1000+20*3*cos(k*pi()/18)*cos(0.4)-20*1*sin(k*pi()/18)*sin(0.4),6)+0.0 AS y FROM (SELECT *, unnest(generate_series(0, 36)) AS k FROM {points})")
def ellipse_rings(spark, sf):
    ring = monitoring.ring(F.col("longitude") * 1000, F.col("latitude") * 1000, F.lit(3.0), F.lit(1.0), F.lit(0.4), 20.0)
    flat = points(spark, sf).select("point", F.posexplode(ring).alias("k", "p"))
    return flat.select("point", F.col("k").cast("long").alias("k"), r(F.col("p.x")).alias("x"), r(F.col("p.y")).alias("y"))


# Of what is bisected, m: chi-square's distribution function as a sum of positive terms, and F's, from the nearer end.
_CHI2 = "list_sum(list_transform(generate_series(0, CAST(m/2 + 10*sqrt(m/2) + 60 AS BIGINT)), lambda i: exp((n/2+i)*ln(m/2) - m/2 - lgamma(n/2+i+1.0))))"
_BETA = "list_sum(list_transform(generate_series(0, CAST({b} + 10*sqrt({b}) + 80 AS BIGINT)), lambda i: exp(lgamma({a}+{b}+i) - lgamma({a}+i+1.0) - lgamma({b}) + ({a}+i)*ln({x}) + {b}*ln({y}))))"
_F = f"CASE WHEN d*m <= n THEN {_BETA.format(a='(d/2)', b='(n/2)', x='(d*m/(d*m+n))', y='(n/(d*m+n))')} ELSE 1 - {_BETA.format(a='(n/2)', b='(d/2)', x='(n/(d*m+n))', y='(d*m/(d*m+n))')} END"

#: Quantiles for each degrees of freedom, and those that need none: kind, dimension or first degrees, probability.
BY_DEGREES = [("chi2", 0, 0.95), ("chi2", 0, 0.05), ("t", 1, 0.975), ("t", 1, 0.95), ("f", 3, 0.95), ("f", 1, 0.95), ("f", 2, 0.95), ("confidence", 2, 0.95), ("confidence", 1, 0.95)]
FIXED = [("normal", 1, 0.975), ("confidence", 2, 0.95), ("confidence", 1, 0.95)]


@query("quantiles", f"""
WITH RECURSIVE sizes AS (SELECT DISTINCT CAST(unnest([p_size, 2*p_size]) AS BIGINT) AS dof FROM part WHERE p_size > 0),
kinds(kind, d, p, level) AS (VALUES ('chi2',0,0.95::DOUBLE,0.95::DOUBLE),('chi2',0,0.05,0.05),('t',1,0.975,0.95),('t',1,0.95,0.9),('f',3,0.95,0.95),('f',1,0.95,0.95),('f',2,0.95,0.95),('confidence',2,0.95,0.95),('confidence',1,0.95,0.95)),
b AS (SELECT kind || ' ' || p || CASE WHEN d > 0 AND kind <> 't' THEN ' ' || d ELSE '' END || ' ' || dof AS name, kind, d, dof, dof AS n, level, 0.0::DOUBLE AS lo, 1000.0 + CASE WHEN d = 0 THEN 2*dof ELSE 0 END::DOUBLE AS hi, 0 AS k FROM sizes, kinds
UNION ALL SELECT name, kind, 0, NULL, n, level, 0.0, 1000.0, 0 FROM (VALUES ('normal 0.975','normal',1,0.95::DOUBLE),('confidence 0.95 2','confidence',2,0.95),('confidence 0.95 1','confidence',1,0.95),('alpha','normal',1,0.999),('beta','normal',1,0.6)) v(name, kind, n, level)),
s AS (SELECT * FROM b
UNION ALL SELECT name, kind, d, dof, n, level, CASE WHEN below THEN m ELSE lo END, CASE WHEN below THEN hi ELSE m END, k+1 FROM (SELECT *, CASE WHEN d = 0 THEN {_CHI2} ELSE {_F} END < level AS below FROM (SELECT *, (lo+hi)/2 AS m FROM s WHERE k < 80))),
e AS (SELECT *, CASE WHEN d = 0 THEN {_CHI2} ELSE {_F} END AS reached FROM (SELECT *, (lo+hi)/2 AS m FROM s WHERE k = 80)),
q AS (SELECT name, dof, CASE kind WHEN 'chi2' THEN m WHEN 'f' THEN m WHEN 'confidence' THEN sqrt(greatest(d, 1)*m) ELSE sqrt(m) END AS quantile, CASE WHEN kind IN ('t', 'normal') THEN (1+reached)/2 ELSE reached END AS probability FROM e),
c AS (SELECT n AS dof, m FROM e WHERE kind = 'chi2' AND level = 0.95)
SELECT name, round(quantile, 6)+0.0 AS quantile, round(probability, 4)+0.0 AS probability, q.dof, round(m, 6)+0.0 AS chi2_95, round(m/q.dof, 6)+0.0 AS factor FROM q LEFT JOIN c ON q.dof = c.dof WHERE name NOT IN ('alpha', 'beta')
UNION ALL SELECT 'non-centrality', round(sum(quantile), 6)+0.0, 0.0, NULL, NULL, NULL FROM q WHERE name IN ('alpha', 'beta')""")
def quantiles(spark, sf):
    """Quantiles and the distribution functions at them, for the distinct degrees of freedom that sizes of parts give; chi-square's beside all."""

    def row(kind, d, p, n=None):
        last = "" if n is None else f" {n}"
        if kind == "chi2":
            q = dist.chi2_quantile(p, n)
            return f"chi2 {p}{last}", q, dist.chi2_cdf(q, n)
        if kind == "t":
            q = dist.t_quantile(p, n)
            return f"t {p}{last}", q, dist.t_cdf(q, n)
        if kind == "f":
            q = dist.f_quantile(p, d, n)
            return f"f {p} {d}{last}", q, dist.f_cdf(q, d, n)
        if kind == "normal":
            q = dist.normal_quantile(p)
            return f"normal {p}", q, dist.normal_cdf(q)
        q = dist.confidence_scale(p, d, n)
        return f"confidence {p} {d}{last}", q, dist.chi2_cdf(q * q, d) if n is None else dist.f_cdf(q * q / d, d, n)

    def run(batches):
        for batch in batches:
            out = []
            for n in batch.column(0).to_pylist():
                chi2 = dist.chi2_quantile(0.95, n)
                out += [(*row(*kind, n), n, chi2, chi2 / n) for kind in BY_DEGREES]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

    names = ["name", "quantile", "probability", "dof", "chi2_95", "factor"]
    arrow = pa.schema([("name", pa.string()), *((x, pa.int64() if x == "dof" else pa.float64()) for x in names[1:])])
    schema = "name string, quantile double, probability double, dof long, chi2_95 double, factor double"
    size = F.col("p_size").cast("long")
    sizes = table(spark, sf, "part").where("p_size > 0").select(F.explode(F.array(size, 2 * size)).alias("dof")).distinct()
    fixed = [*(row(*kind) for kind in FIXED), ("non-centrality", dist.non_centrality(), 0.0)]
    found = sizes.mapInArrow(run, schema).unionByName(spark.createDataFrame([(*x, None, None, None) for x in fixed], schema))
    return found.select("name", r(F.col("quantile")).alias("quantile"), r(F.col("probability"), 4).alias("probability"), "dof", r(F.col("chi2_95")).alias("chi2_95"), r(F.col("factor")).alias("factor"))


@query("printed_epochs", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS epoch FROM orders")
def printed_epochs(spark, sf):
    text = F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.lit("31.02.2020"))
    return table(spark, sf, "orders").select("o_orderkey", records.parse_epoch(text).alias("epoch"))


@query("sp3_spans", "SELECT p_partkey, make_timestamp(2020, CAST(1 + p_size % 12 AS BIGINT), CAST(1 + p_partkey % 28 AS BIGINT), 0, 0, 0.0) AS first, make_timestamp(2020, CAST(1 + p_size % 12 AS BIGINT), CAST(1 + p_partkey % 28 AS BIGINT), 0, 0, 0.0) + INTERVAL 1 SECOND * (900 * (p_size % 96)) AS last FROM part")
def sp3_spans(spark, sf):
    head = F.format_string("#cP2020 %2d %2d  0  0  0.00000000  %6d ORBIT IGS14 HLM  IGS\n## 2086 345600.00000000   900.00000000 58849 0.0000000000000", (1 + F.col("p_size") % 12).cast("int"), (1 + F.col("p_partkey") % 28).cast("int"), (1 + F.col("p_size") % 96).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", records.sp3_span(head, F.lit(None).cast("int")).alias("s"))
    return rows.select("p_partkey", F.col("s.first").cast("timestamp_ntz").alias("first"), F.col("s.last").cast("timestamp_ntz").alias("last"))


@query("fingerprints", """SELECT n_nationkey, sha256('{{"key":' || n_nationkey || ',"name":"' || n_name || '"}}') AS fingerprint FROM nation""")
def fingerprints(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", records.fingerprint(name=F.col("n_name"), key=F.col("n_nationkey"), gone=F.lit(None).cast("string")).alias("fingerprint"))


@query("combined_modes", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_partkey % 5 = 0 THEN 'APPROXIMATE' ELSE 'RIGOROUS' END AS mode, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'NOMINAL' END, CASE WHEN p_partkey % 5 = 0 THEN 'ROUNDED' END) AS strategies FROM part")
def combined_modes(spark, sf):
    a, b = F.col("p_size") % 3 == 0, F.col("p_partkey") % 5 == 0
    mode = records.combined_mode(F.when(a, "APPROXIMATE").otherwise("RIGOROUS"), F.when(b, "APPROXIMATE").otherwise("RIGOROUS"))
    names = records.combined_strategies(F.when(a, F.array(F.lit("NOMINAL"))), F.when(b, F.array(F.lit("ROUNDED"))))
    return table(spark, sf, "part").select("p_partkey", mode.alias("mode"), F.array_join(names, ",").alias("strategies"))


@query("combined_heights", "SELECT point, round(height - CASE WHEN point % 2 = 0 THEN 12.5 ELSE 0 END,6)+0.0 AS height, CASE WHEN point % 2 = 0 THEN 0.0125 ELSE 0.01 END::DOUBLE AS variance FROM {points}")
def combined_heights(spark, sf):
    h, v = records.combined_height(F.col("height"), F.lit(0.01), F.when(F.col("point") % 2 == 0, "ellipsoidal").otherwise("orthometric"), "orthometric", F.lit(12.5), F.lit(0.0025))
    return points(spark, sf).select("point", r(h).alias("height"), r(v, 9).alias("variance"))


#: Closed inverse of a 3 x 3 block and of the whole normal matrix of sightings by elimination, as for networks.
SQL["dilution_of_precision"] = """
WITH s AS (SELECT event_id % 2000 AS session, user_id*0.7 AS a, 0.1+(event_id % 14)/10.0 AS e FROM events), v AS (SELECT session, [cos(e)*sin(a), cos(e)*cos(a), sin(e), 1.0] AS g FROM s),
n AS (SELECT session, count(*) AS satellites, list_transform(generate_series(1, 16), lambda k: 0.0) AS z, [sum(g[1]*g[1]), sum(g[1]*g[2]), sum(g[1]*g[3]), sum(g[1]), sum(g[2]*g[2]), sum(g[2]*g[3]), sum(g[2]), sum(g[3]*g[3]), sum(g[3]), count(*)*1.0] AS m FROM v GROUP BY session),
f AS (SELECT session, satellites, [[m[1],m[2],m[3],m[4],1,0,0,0],[m[2],m[5],m[6],m[7],0,1,0,0],[m[3],m[6],m[8],m[9],0,0,1,0],[m[4],m[7],m[9],m[10],0,0,0,1]] AS m FROM n WHERE satellites >= 4),
g1 AS (SELECT session, satellites, list_transform(m, lambda row, i: CASE WHEN i = 1 THEN list_transform(row, lambda x: x/m[1][1]) ELSE list_transform(row, lambda x, j: x-row[1]*m[1][j]/m[1][1]) END) AS m FROM f),
g2 AS (SELECT session, satellites, list_transform(m, lambda row, i: CASE WHEN i = 2 THEN list_transform(row, lambda x: x/m[2][2]) ELSE list_transform(row, lambda x, j: x-row[2]*m[2][j]/m[2][2]) END) AS m FROM g1),
g3 AS (SELECT session, satellites, list_transform(m, lambda row, i: CASE WHEN i = 3 THEN list_transform(row, lambda x: x/m[3][3]) ELSE list_transform(row, lambda x, j: x-row[3]*m[3][j]/m[3][3]) END) AS m FROM g2),
g4 AS (SELECT session, satellites, list_transform(m, lambda row, i: CASE WHEN i = 4 THEN list_transform(row, lambda x: x/m[4][4]) ELSE list_transform(row, lambda x, j: x-row[4]*m[4][j]/m[4][4]) END) AS m FROM g3)
SELECT n.session, n.satellites, round(sqrt(g4.m[1][5]+g4.m[2][6]+g4.m[3][7]+g4.m[4][8]),3)+0.0 AS gdop, round(sqrt(g4.m[1][5]+g4.m[2][6]+g4.m[3][7]),3)+0.0 AS pdop, round(sqrt(g4.m[1][5]+g4.m[2][6]),3)+0.0 AS hdop, round(sqrt(g4.m[3][7]),3)+0.0 AS vdop FROM n LEFT JOIN g4 ON n.session = g4.session"""
