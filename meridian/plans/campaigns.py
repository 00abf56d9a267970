"""Queries of campaigns: deformation of many at once, work a key, products and status files."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.operators import batch, congruency, frames, products
from meridian.plans.registry import query, r, table
from meridian.sources import sessions

#: Eight stations a campaign, of which five are the reference; differences come out of sizes, so that some references have moved.
_MOVED = """SELECT p_partkey // 8 AS campaign, p_partkey % 8 AS k, p_partkey % 8 < 5 AS reference, (p_partkey // 8 % 5) * 0.3 * (p_size % 7 - 3) AS dx, (p_partkey // 8 % 4) * 0.4 * (p_partkey % 11 - 5) AS dy FROM part"""


def _moved(spark, sf):
    k = F.col("p_partkey")
    block = F.floor(k / 8)
    return table(spark, sf, "part").select(
        block.alias("campaign"), F.concat(F.lit("S"), (k % 8).cast("string")).alias("station"), (k % 8 < 5).alias("reference"),
        ((block % 5) * 0.3 * (F.col("p_size") % 7 - 3)).alias("x"), ((block % 4) * 0.4 * (F.col("p_partkey") % 11 - 5)).alias("y"),
    )


def _campaign_tables(spark, sf):
    m = _moved(spark, sf)
    d = m.select("campaign", F.explode(F.array(*(F.struct(F.concat_ws(":", "station", F.lit(c)).alias("i"), F.col(c).alias("v")) for c in "xy"))).alias("e")).select("campaign", "e.*")
    q = d.select("campaign", "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    places = m.select("campaign", "station", *(F.lit(0.0).alias(c) for c in "xyz"), "reference")
    return d, q, places, m.select("campaign").distinct().withColumns({"pooled": F.lit(1.0), "dof": F.lit(0)})


#: The chi-square distribution function for an even number of degrees of freedom h, in closed form.
_CHI2 = "1 - exp(-({x})/2) * list_sum(list_transform(generate_series(0, ({h})//2-1), lambda i: pow(({x})/2, i) / factorial(CAST(i AS INTEGER))))"


@query("deformation_of_objects", f"""
WITH d AS ({_MOVED}), m AS (SELECT campaign, count(*) AS n, avg(dx) AS mx, avg(dy) AS my FROM d WHERE reference GROUP BY campaign),
t AS (SELECT campaign, n, mx, my, omega, 2*(n-1) AS h FROM (SELECT d.campaign, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((dx-mx)*(dx-mx)+(dy-my)*(dy-my)) AS omega FROM d JOIN m USING (campaign) WHERE reference GROUP BY d.campaign)),
s AS (SELECT *, CASE WHEN n < 2 THEN 'no_reference' WHEN {_CHI2.format(x="omega", h="greatest(h, 2)")} <= 0.95 THEN 'analysed' ELSE 'unstable_reference' END AS status FROM t),
o AS (SELECT d.campaign, k, reference, coalesce(status, 'no_reference') AS status, ((dx-mx)*(dx-mx)+(dy-my)*(dy-my)) / (1 + CASE WHEN reference THEN -1.0 ELSE 1.0 END / n) AS omega FROM d LEFT JOIN s USING (campaign))
SELECT campaign, 'S' || k AS station, CASE WHEN reference THEN 'reference' ELSE 'object' END AS role, status, CASE WHEN status = 'analysed' THEN round(omega, 5)+0.0 END AS statistic, CASE WHEN status = 'analysed' THEN 1 - exp(-omega/2) > 0.95 END AS significant FROM o""")
def deformation_of_objects(spark, sf):
    """Movements of independent stations against the reference of their campaign; campaigns whose reference has moved are not analysed."""
    found = congruency.deformation(*_campaign_tables(spark, sf), ["campaign"], ("x", "y"))
    return found.select("campaign", "station", "role", "status", r(F.col("statistic"), 5).alias("statistic"), "significant")


@query("localised_reference")
def localised_reference(spark, sf):
    """Which stations leave the reference of each campaign, and in which order."""
    found = congruency.localised(*_campaign_tables(spark, sf), ["campaign"], ("x", "y"))
    return found.select("campaign", "step", "station", *(r(F.col(c), 5).alias(c) for c in ("omega", "statistic", "critical", "share")), "h", "congruent")


@query("batch_outcomes", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'FAILED' WHEN sqrt(c_acctbal) < 30 THEN 'REJECTED' ELSE 'SUCCEEDED' END AS outcome, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN sqrt(c_acctbal) < 30 THEN 'rejected' END AS code,
CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6)+0.0 END AS root FROM customer""")
def batch_outcomes(spark, sf):
    """A root a customer, which fails for debts and is rejected if small."""

    def root(row):
        if row["c_acctbal"] < 0:
            raise batch.DomainError("negative", str(row["c_acctbal"]))
        return {"root": float(row["c_acctbal"]) ** 0.5}

    tasks = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    report = batch.run_batch(tasks, "c_custkey", root, "root double", accept=lambda v: v["root"] >= 30)
    return report.select("c_custkey", "outcome", "code", r(F.col("value.root")).alias("root"))


@query("resolved_products", """
WITH q AS (SELECT DISTINCT 'c' || o_custkey % 5 AS campaign, CAST(o_orderdate AS DATE) AS day FROM orders), f AS (SELECT p_partkey AS k, p_size, DATE '1992-01-01' + CAST(p_partkey AS INTEGER) AS day FROM part),
c AS (SELECT day, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS step, 0 AS how, 'igs' || k AS name, CASE WHEN k % 3 = 0 THEN 'final' ELSE 'rapid' END AS used FROM f WHERE k % 3 < 2 UNION ALL SELECT day, 0, 1, 'com' || k, 'final' FROM f WHERE k % 3 = 2 AND p_size >= 24),
b AS (SELECT q.*, row_number() OVER (PARTITION BY campaign, q.day ORDER BY step, how, name) AS n, step, how, used FROM q LEFT JOIN c ON c.day = q.day)
SELECT campaign, day, used, CASE how WHEN 0 THEN 'name' WHEN 1 THEN 'span' END AS found_by, step > 0 AS substituted FROM b WHERE n = 1""")
def resolved_products(spark, sf):
    """An orbit for each day with orders, out of files named or headed by days of parts, with one step down where the best is missing."""
    asked = table(spark, sf, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("campaign"), F.lit("orbit").alias("kind"), F.to_date("o_orderdate").alias("day"), F.lit("final").alias("latency")).distinct()
    k = F.col("p_partkey")
    day = F.date_add(F.lit("1992-01-01").cast("date"), k.cast("int"))
    week = F.datediff(day, F.lit("1980-01-06").cast("date"))
    name = F.when(k % 3 == 2, F.concat(F.lit("/p/com"), k.cast("string"), F.lit(".sp3"))).otherwise(F.concat(F.when(k % 3 == 0, "/p/igs").otherwise("/p/igr"), F.format_string("%04d%d.sp3", F.floor(week / 7).cast("int"), (week % 7).cast("int"))))
    # quarter hours from midnight: p_size hours
    head = F.format_string("#cP%4d %2d %2d  0  0  0.00000000  %6d ORBIT IGS14 HLM  IGS\n## 2086 345600.00000000   900.00000000 58849 0.0000000000000", F.year(day), F.month(day), F.dayofmonth(day), (4 * F.col("p_size")).cast("int"))
    out = products.resolve(asked, products.coverage(table(spark, sf, "part").select(name.alias("path"), F.encode(head, "UTF-8").alias("head"))), fallback=True)
    rows = out["resolved"].select("campaign", "day", "used", "found_by").unionByName(out["missing"].select("campaign", "day", F.lit(None).cast("string").alias("used"), F.lit(None).cast("string").alias("found_by")))
    lower = out["substituted"].select("campaign", "day", F.lit(True).alias("lower"))
    return rows.join(lower, ["campaign", "day"], "left").select("campaign", "day", "used", "found_by", F.when(F.col("used").isNotNull(), F.coalesce("lower", F.lit(False))).alias("substituted"))


@query("status_epochs", """
WITH e AS (SELECT user_id, event_id, event_id * 7 % 50 AS t, event_id % 9 AS sat, 1 + event_id % 2 AS freq, event_id % 5 <> 0 AS valid, event_id % 4 % 2 = 1 AS slip, CAST(floor(abs(value)) AS BIGINT) % 4 AS rejected FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY event_id) = 1),
g AS (SELECT *, rejected <> 0 AND rejected <> coalesce(lag(rejected) OVER (PARTITION BY user_id, sat, freq ORDER BY event_id), 0) AS moved FROM f)
SELECT 'u' || user_id AS path, make_timestamp(1980, 1, 6, 0, 0, 0.0) + INTERVAL 1 SECOND * (2300*604800 + t) AS instant, CASE WHEN valid AND freq = 1 THEN 1 ELSE 0 END AS sightings, CASE WHEN valid AND slip THEN 'G0' || sat || '/' || freq ELSE '' END AS slips, CASE WHEN moved THEN 'G0' || sat || '/' || freq ELSE '' END AS rejections FROM g""")
def status_epochs(spark, sf):
    """A status file a user: each event is an epoch's block, and epochs come again."""
    k = F.col("event_id")
    text = lambda pattern, *c: F.format_string(pattern, *c)
    t = (k * 7 % 50).cast("double")
    position = text("$POS,2300,%.3f,1,0,0,0,0,0,0", t)
    satellite = text(
        "$SAT,2300,%.3f,G0%d,%d,10.0,45.0,0.1,0.01,%d,40,1,%d,5,0,1,%d,0,0",
        t, k % 9, 1 + k % 2, F.when(k % 5 != 0, 1).otherwise(0), k % 4, F.floor(F.abs("value")) % 4,
    )
    lines = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.posexplode(F.array(position, satellite)).alias("n", "line"), "event_id")
    status = sessions.read_status(lines.select("path", F.struct(F.col("event_id").alias("start"), F.col("n").cast("long").alias("k")).alias("order"), "line"))
    return status.select("path", F.col("instant").cast("timestamp_ntz").alias("instant"), F.size("sightings").cast("int").alias("sightings"), F.array_join("slips", ",").alias("slips"), F.array_join("rejections", ",").alias("rejections"))


#: Three transformations between four frames; D leads to A, so A to D is a way back.
_HELD = (("A", "B", "ab", 1.5, -2.0, 0.5, 2e-6, 1e-6, -2e-6, 3e-6, 0.01), ("B", "C", "bc", -0.5, 1.0, 2.0, -1e-6, 2e-6, 1e-6, -1e-6, -0.02), ("D", "A", "da", 3.0, 4.0, -5.0, 4e-6, 0.0, 0.0, 0.0, 0.05))


def _leg_sql(code: str, of: str) -> str:
    """Coordinates of `of` after a leg, with its shift moving at a yearly rate; the way back of a leg without rotations."""
    _, _, _, tx, ty, tz, s, rx, ry, rz, rate = next(h for h in _HELD if h[2] == code.removeprefix("-"))
    shift = [f"({t} + {rate}*(epoch-2010))" for t in (tx, ty, tz)]
    if code.startswith("-"):
        return ", ".join(f"({c}-{t})/(1+{s}) AS {c}" for c, t in zip("xyz", shift, strict=True)) + f" FROM {of}"
    return f"{shift[0]}+(1+{s})*x-({rz})*y+({ry})*z AS x, {shift[1]}+({rz})*x+(1+{s})*y-({rx})*z AS y, {shift[2]}-({ry})*x+({rx})*y+(1+{s})*z AS z FROM {of}"


@query("transformed_positions", f"""
WITH p AS (SELECT c_custkey AS k, 2000 + c_custkey % 20 AS epoch, substr('ABCDE', CAST(1 + c_custkey % 5 AS INTEGER), 1) AS target, 4e6 + c_acctbal AS x, 1e6 - c_acctbal AS y, 4.8e6 + c_custkey AS z FROM customer),
b AS (SELECT k, epoch, target, {_leg_sql("ab", "p")}), c AS (SELECT k, epoch, target, {_leg_sql("bc", "b")}), d AS (SELECT k, epoch, target, {_leg_sql("-da", "p")}),
o AS (SELECT k, x, y, z, '' AS codes FROM p WHERE target = 'A' UNION ALL SELECT k, x, y, z, 'ab' FROM b WHERE target = 'B' UNION ALL SELECT k, x, y, z, 'ab,bc' FROM c WHERE target = 'C' UNION ALL SELECT k, x, y, z, '-da' FROM d WHERE target = 'D')
SELECT p.k AS point, round(o.x, 5)+0.0 AS x, round(o.y, 5)+0.0 AS y, round(o.z, 5)+0.0 AS z, coalesce(codes, '') AS codes FROM p LEFT JOIN o ON o.k = p.k""")
def transformed_positions(spark, sf):
    """Positions in frame A brought to the frames that are held, over one leg, two, or one backwards; E can't be reached."""
    rows = [(a, b, code, 2010.0, *p[:7], rate, 0.01) for a, b, code, *p, rate in _HELD]
    held = spark.createDataFrame(rows, "source string, target string, code string, epoch double, tx double, ty double, tz double, scale double, rx double, ry double, rz double, d_t double, accuracy double")
    held = held.withColumns({f"d_{p}": F.col("d_t") if p in ("tx", "ty", "tz") else F.lit(0.0) for p in frames.PARAMETERS})
    k, a = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    target = F.substring(F.lit("ABCDE"), (1 + k % 5).cast("int"), F.lit(1))
    points = table(spark, sf, "customer").select(k.alias("point"), F.lit("A").alias("source"), target.alias("target"), (2000 + k % 20).cast("double").alias("epoch"), (4e6 + a).alias("x"), (1e6 - a).alias("y"), (4.8e6 + k).alias("z"))
    out = frames.transformed(points, held)
    return out.select("point", *(r(F.col(c), 5).alias(c) for c in "xyz"), F.array_join("codes", ",").alias("codes"))
