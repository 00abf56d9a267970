"""Networks for the adjustment out of reduced field work: stations, observations and covariances as adjust() takes them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.geodesy import enu_rotation
from meridian.operators.network import connected_components, rooted, tree_paths
from meridian.operators.total_station import line_scale, to_ellipsoid
from meridian.functions.uncertainty import transform
from meridian.sources.shared import stored

OBSERVATION = ["network_id", "obs", "type", "at", "to", "third", "value", "variance", "setup"]
#: What each type takes off the datum defect of a frame, and what the frames can lack.
FIXES = {
    "HORIZONTAL_DISTANCE": ("scale",), "SLOPE_DISTANCE": ("scale",), "AZIMUTH": ("rotation",), "ZENITH_ANGLE": ("tilt_x", "tilt_y"), "VERTICAL_ANGLE": ("tilt_x", "tilt_y"),
    "HEIGHT": ("z",), "GRAVITY": ("z",), "HEIGHT_DIFFERENCE": (), "GRAVITY_DIFFERENCE": (), "DIRECTION": (), "HORIZONTAL_ANGLE": (),
    "X_DIFFERENCE": ("scale", "rotation", "tilt_x", "tilt_y"), "Y_DIFFERENCE": ("scale", "rotation", "tilt_x", "tilt_y"), "Z_DIFFERENCE": ("scale", "rotation", "tilt_x", "tilt_y"),
    "X_COORDINATE": ("x", "scale", "rotation", "tilt_x", "tilt_y"), "Y_COORDINATE": ("y", "scale", "rotation", "tilt_x", "tilt_y"), "Z_COORDINATE": ("z", "scale", "rotation", "tilt_x", "tilt_y"),
}
_SPACE = ("x", "y", "z", "tilt_x", "tilt_y", "rotation", "scale")
LACKS = {"height_1d": ("z",), "gravity_1d": ("z",), "plane_2d": ("x", "y", "rotation", "scale"), "local_3d": _SPACE, "geocentric_3d": _SPACE}


def _observation(**own: Column) -> list[Column]:
    return [own.get(n, F.lit(None).cast("string")).alias(n) for n in OBSERVATION] + [v.alias(n) for n, v in own.items() if n not in OBSERVATION]


def detect_defect(observations: DataFrame, frame: str) -> DataFrame:
    """(network_id, defect array<string>): what the frame can lack less what the types observed in each network fix. A held station
    fixes its part besides."""
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for pair in FIXES.items() for x in pair))
    fixed = observations.select("network_id", F.explode_outer(table[F.col("type")]).alias("f")).groupBy("network_id").agg(F.collect_set("f").alias("f"))
    return fixed.select("network_id", F.array_except(F.array(*map(F.lit, LACKS[frame])), "f").alias("defect"))


def support_findings(observations: DataFrame, frame: str) -> DataFrame:
    """(network_id, type, n): observations of types that have no equation, or none in the frame."""
    gravity = F.col("type").isin("GRAVITY", "GRAVITY_DIFFERENCE")
    fits = F.col("type").isin(*FIXES) & (gravity if frame == "gravity_1d" else ~gravity)
    if frame in ("height_1d", "plane_2d"):
        heights = ("HEIGHT", "HEIGHT_DIFFERENCE", "Z_DIFFERENCE", "Z_COORDINATE")
        plane = ("HORIZONTAL_DISTANCE", "AZIMUTH", "DIRECTION", "HORIZONTAL_ANGLE", "X_DIFFERENCE", "Y_DIFFERENCE", "X_COORDINATE", "Y_COORDINATE")
        fits &= F.col("type").isin(*(heights if frame == "height_1d" else plane))
    return observations.where(~F.coalesce(fits, F.lit(False))).groupBy("network_id", "type").agg(F.count("*").alias("n"))


def weighted_constraints(stations: DataFrame) -> DataFrame:
    """Coordinates with a variance (variance_x, variance_y, variance_z) as observations of their stations."""
    parts = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v"), F.col(f"variance_{c}").alias("s")) for c in "xyz"))
    flat = stations.where(~F.coalesce("fixed", F.lit(False))).select("network_id", "station", F.explode(parts).alias("p")).where("p.s > 0 and p.v is not null")
    return flat.select(*_observation(network_id=F.col("network_id"), obs=F.concat_ws(":", F.lit("constraint"), "station", "p.c"), type=F.concat(F.upper("p.c"), F.lit("_COORDINATE")), at=F.col("station"), value=F.col("p.v"), variance=F.col("p.s")))


# ---- total station


def single_face(readings: DataFrame, instruments: DataFrame) -> DataFrame:
    """Horizontal and zenith of a pointing on one face (face D or R), corrected by the instrument's collimation and vertical index, whose
    variances (collimation_variance, vertical_index_variance) go into the result."""
    own = readings.join(instruments, "instrument", "left")
    c, i = F.coalesce("collimation", F.lit(0.0)), F.coalesce("vertical_index", F.lit(0.0))
    direct = F.col("face") == "D"
    turn = F.pmod(F.when(direct, F.col("horizontal") - c).otherwise(F.col("horizontal") + c - np.pi), F.lit(2 * np.pi))
    zenith = F.when(direct, F.col("zenith") - i).otherwise(2 * np.pi - F.col("zenith") - i)
    out = {"horizontal": turn, "zenith": zenith, "horizontal_variance": F.col("horizontal_variance") + F.coalesce("collimation_variance", F.lit(0.0)), "zenith_variance": F.col("zenith_variance") + F.coalesce("vertical_index_variance", F.lit(0.0))}
    return own.withColumns(out).select(readings.columns)


def trunnion(reductions: DataFrame, tilt: Column, tilt_variance: Column) -> DataFrame:
    """Adds tilt * cot(zenith) to the direction; within a degree of the vertical it is left, and flagged near_vertical."""
    cot = F.cos("zenith") / F.sin("zenith")
    near = F.abs(F.sin("zenith")) < float(np.sin(np.radians(1.0)))
    zenith_part = (tilt / (F.sin("zenith") * F.sin("zenith"))) ** 2 * F.col("zenith_variance")
    return reductions.withColumns({
        "near_vertical": near,
        "horizontal": F.when(near, F.col("horizontal")).otherwise(F.pmod(F.col("horizontal") + tilt * cot, F.lit(2 * np.pi))),
        "horizontal_variance": F.when(near, F.col("horizontal_variance")).otherwise(F.col("horizontal_variance") + cot * cot * tilt_variance + zenith_part),
    })


def resolved_sigma(stated: Column, instrument: Column, default: Column, sets: Column) -> tuple[Column, Column]:
    """A sigma and where it is from: stated with the reading, else of the instrument, else of the type; the last two improve with the root
    of the sets. Raises where there is none, or a negative one."""
    nominal = F.coalesce(instrument, default) / F.sqrt(sets)
    sigma = F.when(stated < 0, F.raise_error(F.lit("a stated sigma is negative"))).otherwise(F.coalesce(stated, nominal, F.raise_error(F.lit("no sigma is stated, of the instrument or of the type")).cast("double")))
    source = F.when(stated.isNotNull(), "STATED").when(instrument.isNotNull(), "NOMINAL_PRECISION").otherwise("TYPE_DEFAULT")
    return sigma, source


def total_station_observations(reductions: DataFrame, dimension: int) -> DataFrame:
    """Observations of reduced pointings (network_id, setup, station, target, horizontal, zenith, distance along the slope, their
    variances, instrument_height, target_height): directions and horizontal distances (2), directions, zenith angles and slope
    distances (3), or height differences between marks (1)."""
    d, z = F.col("distance"), F.col("zenith")
    dv, zv = F.col("distance_variance"), F.col("zenith_variance")
    offset = F.coalesce("target_height", F.lit(0.0)) - F.coalesce("instrument_height", F.lit(0.0))
    flat = (d * F.sin(z), F.sin(z) ** 2 * dv + (d * F.cos(z)) ** 2 * zv)
    rise = (d * F.cos(z) - offset, F.cos(z) ** 2 * dv + (d * F.sin(z)) ** 2 * zv)
    kinds = {
        1: [("HEIGHT_DIFFERENCE", *rise)],
        2: [("DIRECTION", F.col("horizontal"), F.col("horizontal_variance")), ("HORIZONTAL_DISTANCE", *flat)],
        3: [("DIRECTION", F.col("horizontal"), F.col("horizontal_variance")), ("ZENITH_ANGLE", z, zv), ("SLOPE_DISTANCE", d, dv)],
    }[dimension]
    parts = F.array(*(F.struct(F.lit(k).alias("type"), v.alias("value"), s.alias("variance")) for k, v, s in kinds))
    flat_rows = reductions.select("network_id", F.col("setup").cast("string").alias("setup"), "station", "target", offset.alias("height_offset"), F.explode(parts).alias("p")).where("p.value is not null")
    name = F.concat_ws(":", "setup", "target", "p.type")
    return flat_rows.select(*_observation(network_id=F.col("network_id"), obs=name, type=F.col("p.type"), at=F.col("station"), to=F.col("target"), value=F.col("p.value"), variance=F.col("p.variance"), setup=F.when(F.col("p.type") == "DIRECTION", F.col("setup")), height_offset=F.col("height_offset")))


def network_stations(observations: DataFrame, known: DataFrame) -> DataFrame:
    """All stations that observations name, with the coordinates and `fixed` of those that are known."""
    named = observations.select("network_id", F.explode(F.array("at", "to", "third")).alias("station")).where("station is not null").distinct()
    return named.join(known, ["network_id", "station"], "left").select("network_id", "station", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in "xyz"), F.coalesce("fixed", F.lit(False)).alias("fixed"))


def distances_to_grid(observations: DataFrame, stations: DataFrame, scale, undulation: float = 0.0, radius: float = 6371000.0) -> DataFrame:
    """Horizontal distances between stations (x, y, z) brought to the ellipsoid at their mean height, then to the grid by Simpson's mean of
    the point scale `scale(x, y)`; others, and those with `on_grid`, pass through. Adds on_grid and the factor."""
    marked = F.coalesce(F.col("on_grid"), F.lit(False)) if "on_grid" in observations.columns else F.lit(False)
    end = lambda role, p: stations.select("network_id", F.col("station").alias(role), *(F.col(c).alias(f"_{p}{c}") for c in "xyz"))
    both = observations.join(end("at", "a"), ["network_id", "at"], "left").join(end("to", "b"), ["network_id", "to"], "left")
    mean = lambda c: (F.col(f"_a{c}") + F.col(f"_b{c}")) / 2.0
    k = line_scale(scale(F.col("_ax"), F.col("_ay")), scale(mean("x"), mean("y")), scale(F.col("_bx"), F.col("_by")))
    factor = F.when((F.col("type") == "HORIZONTAL_DISTANCE") & ~marked, to_ellipsoid(F.lit(1.0), mean("z"), undulation, radius) * k).otherwise(1.0)
    changed = (F.col("type") == "HORIZONTAL_DISTANCE") | marked
    return both.withColumn("factor", factor).withColumn("value", F.col("value") * F.col("factor")).withColumn("variance", F.col("variance") * F.col("factor") ** 2).withColumn("on_grid", changed).select(*observations.columns, *([] if "on_grid" in observations.columns else ["on_grid"]), "factor")


# ---- levelling


def level_network(lines: DataFrame, benchmarks: DataFrame, network_id: str = "levelling") -> tuple[DataFrame, DataFrame]:
    """(stations, observations) of reduced lines between their ends; benchmarks (station, height, variance) are held where they have no
    variance, and observed where they have one. The lines are evaluated once."""
    net = F.lit(network_id)
    rows = lines.where(F.col("from") != F.col("to")).select(*_observation(network_id=net, obs=F.concat_ws(":", F.lit("line"), F.col("line").cast("string")), type=F.lit("HEIGHT_DIFFERENCE"), at=F.col("from"), to=F.col("to"), value=F.col("height_difference"), variance=F.col("variance")))
    return _with_benchmarks(stored(rows), benchmarks, network_id)


def _with_benchmarks(rows: DataFrame, benchmarks: DataFrame, network_id: str) -> tuple[DataFrame, DataFrame]:
    soft = benchmarks.where("variance > 0").select(*_observation(network_id=F.lit(network_id), obs=F.concat_ws(":", F.lit("benchmark"), "station"), type=F.lit("HEIGHT"), at=F.col("station"), value=F.col("height"), variance=F.col("variance")))
    known = benchmarks.select(F.lit(network_id).alias("network_id"), "station", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("height").alias("z"), (F.coalesce("variance", F.lit(0.0)) == 0).alias("fixed"))
    return network_stations(rows, known), rows.unionByName(soft.join(rows.select(F.explode(F.array("at", "to")).alias("at")).distinct(), "at", "left_semi"))


def setup_network(sights: DataFrame, benchmarks: DataFrame, covariances: DataFrame, network_id: str = "levelling") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stations, observations, covariances) with one observation a foresight (setup, from, target, height_difference); those of a setup
    share its backsight, as foresight_covariances (setup, first, second, covariance) says."""
    name = lambda t: F.concat_ws(":", F.lit("setup"), F.col("setup").cast("string"), F.col(t).cast("string"))
    own = covariances.select("setup", F.col("first").alias("target"), F.col("covariance").alias("variance"), "second").where("target = second").drop("second")
    rows = sights.join(own, ["setup", "target"]).select(*_observation(network_id=F.lit(network_id), obs=name("target"), type=F.lit("HEIGHT_DIFFERENCE"), at=F.col("from"), to=F.col("target").cast("string"), value=F.col("height_difference"), variance=F.col("variance")))
    stations, rows = _with_benchmarks(rows, benchmarks, network_id)
    shared = covariances.where("first <> second").select(F.lit(network_id).alias("network_id"), name("first").alias("obs_a"), name("second").alias("obs_b"), "covariance")
    return stations, rows, shared


def add_height_differences(observations: DataFrame, differences: DataFrame, technique: str) -> DataFrame:
    """Another technique's height differences (network_id, obs, at, to, value, variance) beside those that are there."""
    new = differences.select(*_observation(**{c: F.col(c) for c in ("network_id", "at", "to", "value", "variance")}, obs=F.concat_ws(":", F.lit(technique), "obs"), type=F.lit("HEIGHT_DIFFERENCE")), F.lit(technique).alias("technique"))
    return observations.unionByName(new, allowMissingColumns=True)


def harmonised(benchmarks: DataFrame) -> DataFrame:
    """Benchmarks (station, height, variance, height_type, undulation, undulation_variance) with orthometric heights H = h - N. Raises where
    an ellipsoidal height has no undulation, or a height is of another type."""
    ellipsoidal = F.col("height_type") == "ellipsoidal"
    wrong = F.raise_error(F.concat(F.lit("no way from this height to an orthometric one: "), F.coalesce("station", F.lit("?")))).cast("double")
    height = F.when(F.col("height_type") == "orthometric", F.col("height")).when(ellipsoidal & F.col("undulation").isNotNull(), F.col("height") - F.col("undulation")).otherwise(wrong)
    variance = F.col("variance") + F.when(ellipsoidal, F.coalesce("undulation_variance", F.lit(0.0))).otherwise(0.0)
    return benchmarks.select("station", height.alias("height"), variance.alias("variance"), F.lit("orthometric").alias("height_type"))


# ---- gravimetry


def gravity_network(visits: DataFrame, known: DataFrame, network_id: str = "gravity", drift: bool = True, hours: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stations, observations, covariances) of occupations (session, visit, station, value, variance, seconds): successive differences, of
    which neighbours share a visit and so have minus its variance as covariance. A drift has the session as its owner and times in units of
    `hours`. known (station, value, variance): held without a variance, else observed."""
    w = Window.partitionBy("session").orderBy("visit")
    start = F.first("seconds").over(w)
    unit = 3600.0 * hours
    nxt = lambda c: F.lead(c).over(w)
    steps = visits.select("session", "visit", F.col("station").alias("at"), nxt("station").alias("to"), (nxt("value") - F.col("value")).alias("value"), (nxt("variance") + F.col("variance")).alias("variance"), ((F.col("seconds") - start) / unit).alias("elapsed_at"), ((nxt("seconds") - start) / unit).alias("elapsed_to"), nxt("variance").alias("shared")).where("to is not null")
    name = F.concat_ws(":", F.lit("visit"), F.col("session").cast("string"), F.col("visit").cast("string"))
    after = F.concat_ws(":", F.lit("visit"), F.col("session").cast("string"), F.lead("visit").over(w).cast("string"))
    owner = F.col("session").cast("string") if drift else F.lit(None).cast("string")
    rows = steps.select(*_observation(network_id=F.lit(network_id), obs=name, type=F.lit("GRAVITY_DIFFERENCE"), at=F.col("at"), to=F.col("to"), value=F.col("value"), variance=F.col("variance"), setup=owner, elapsed_at=F.col("elapsed_at"), elapsed_to=F.col("elapsed_to")))
    shared = steps.select(F.lit(network_id).alias("network_id"), name.alias("obs_a"), after.alias("obs_b"), (-F.col("shared")).alias("covariance"), F.lead("visit").over(w).alias("more")).where("more is not null").drop("more")
    none = F.lit(None).cast("double")
    soft = known.where("variance > 0").select(*_observation(network_id=F.lit(network_id), obs=F.concat_ws(":", F.lit("absolute"), "station"), type=F.lit("GRAVITY"), at=F.col("station"), value=F.col("value"), variance=F.col("variance"), elapsed_at=none, elapsed_to=none))
    held = known.select(F.lit(network_id).alias("network_id"), "station", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("value").alias("z"), (F.coalesce("variance", F.lit(0.0)) == 0).alias("fixed"))
    both = rows.unionByName(soft)
    return network_stations(both, held), both, shared


def estimable_drifts(visits: DataFrame, degree: int = 1, hours: float = 1.0) -> DataFrame:
    """(session, estimable): whether a session's own visits determine its drift: stations and powers of time have full rank."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(rows["station"].astype(str), return_inverse=True)
        tau = (rows["seconds"] - rows["seconds"].min()).to_numpy() / (3600.0 * hours)
        columns = len(names) + degree
        design = np.zeros((len(rows), columns))
        design[np.arange(len(rows)), at] = 1.0
        for k in range(1, degree + 1):
            design[:, len(names) + k - 1] = tau**k
        good = len(rows) >= columns and int(np.linalg.matrix_rank(design)) == columns
        return pd.DataFrame({"session": [rows["session"].iloc[0]], "estimable": [good]})

    kind = visits.schema["session"].dataType.simpleString()
    return visits.select("session", "station", "seconds").groupBy("session").applyInPandas(one, f"session {kind}, estimable boolean")


# ---- GNSS


def reduced_to_marks(baselines: DataFrame) -> DataFrame:
    """Baselines between antennas (dx, dy, dz, their covariances, and for base and rover latitude, longitude and offset e, n, u with
    variances, as base_latitude, base_e, base_e_variance ...) brought to the marks: each end's offset is turned at its own station."""
    out, s = [F.col(c) for c in ("dx", "dy", "dz")], [[F.col(c) for c in row] for row in (("cxx", "cxy", "cxz"), ("cxy", "cyy", "cyz"), ("cxz", "cyz", "czz"))]
    for end, sign in (("base", 1.0), ("rover", -1.0)):
        r = [list(c) for c in zip(*enu_rotation(F.col(f"{end}_latitude"), F.col(f"{end}_longitude")), strict=True)]
        o = [F.coalesce(F.col(f"{end}_{c}"), F.lit(0.0)) for c in "enu"]
        out = [v + sign * (row[0] * o[0] + row[1] * o[1] + row[2] * o[2]) for v, row in zip(out, r, strict=True)]
        spread = [[F.coalesce(F.col(f"{end}_{c}_variance"), F.lit(0.0)) if i == j else F.lit(0.0) for j in range(3)] for i, c in enumerate("enu")]
        s = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(s, transform(r, spread), strict=True)]
    names = {"cxx": s[0][0], "cxy": s[0][1], "cxz": s[0][2], "cyy": s[1][1], "cyz": s[1][2], "czz": s[2][2]}
    return baselines.withColumns(dict(zip(("dx", "dy", "dz"), out, strict=True)) | names)


def baseline_cluster(baselines: DataFrame, network_id: str = "gnss") -> tuple[DataFrame, DataFrame]:
    """(observations, covariances): three coordinate differences a baseline, correlated as its covariance says."""
    parts = F.array(*(F.struct(F.lit(c.upper()).alias("c"), F.col(f"d{c}").alias("v"), F.col(f"c{c}{c}").alias("s")) for c in "xyz"))
    name = lambda c: F.concat_ws(":", F.col("baseline").cast("string"), c)
    flat = baselines.select("baseline", "base", "rover", F.explode(parts).alias("p"))
    rows = flat.select(*_observation(network_id=F.lit(network_id), obs=name(F.col("p.c")), type=F.concat(F.col("p.c"), F.lit("_DIFFERENCE")), at=F.col("base"), to=F.col("rover"), value=F.col("p.v"), variance=F.col("p.s")))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{a.lower()}{b.lower()}").alias("s")) for a, b in (("X", "Y"), ("X", "Z"), ("Y", "Z"))))
    off = baselines.select("baseline", F.explode(pairs).alias("p"))
    return rows, off.select(F.lit(network_id).alias("network_id"), name(F.col("p.a")).alias("obs_a"), name(F.col("p.b")).alias("obs_b"), F.col("p.s").alias("covariance"))


def independent_subset(baselines: DataFrame) -> DataFrame:
    """Adds `independent`: the baselines of the best spanning forest. Better is a smaller trace of the covariance to nine figures, then the
    smaller name. Each round every piece takes its best baseline to another, which halves the pieces at least."""
    trace = F.col("cxx") + F.col("cyy") + F.col("czz")
    size = F.pow(F.lit(10.0), 8 - F.floor(F.log10(F.when(trace > 0, trace).otherwise(1.0))))
    edges = stored(baselines.where("base <> rover").select("baseline", F.col("base").alias("a"), F.col("rover").alias("b"), F.struct((F.round(trace * size) / size).alias("t"), F.col("baseline").cast("string").alias("n"), F.col("baseline").alias("baseline")).alias("rank")))
    stations = stored(edges.select(F.lit("g").alias("network_id"), F.explode(F.array("a", "b")).alias("station")).distinct())
    labels = stations.withColumn("component", F.col("station"))
    chosen = None
    while True:
        own = labels.select("station", "component")
        crossing = edges.join(own.select(F.col("station").alias("a"), F.col("component").alias("la")), "a").join(own.select(F.col("station").alias("b"), F.col("component").alias("lb")), "b").where("la <> lb")
        best = crossing.select(F.explode(F.array("la", "lb")).alias("l"), "rank").groupBy("l").agg(F.min("rank").alias("rank"))
        new = stored(best.select("rank.baseline").distinct())
        if new.isEmpty():
            break
        chosen = stored(new if chosen is None else chosen.unionByName(new))
        labels = connected_components(stations, edges.join(chosen, "baseline", "left_semi").select(F.lit("g").alias("network_id"), "a", "b"))
    if chosen is None:
        return baselines.withColumn("independent", F.lit(False))
    return baselines.join(chosen.withColumn("independent", F.lit(True)), "baseline", "left").withColumn("independent", F.coalesce("independent", F.lit(False)))


def closing_loops(baselines: DataFrame) -> DataFrame:
    """(loop, seq, baseline, sign): for each baseline that is not independent, itself and then the legs that lead back from its rover to
    its base through independent ones; not where one of these joins the same two stations. The independent ones are a forest, whose
    paths are found in rounds that grow with the logarithm of its depth."""
    one = F.lit("g").alias("network_id")
    forest = rooted(baselines.where("independent").select(one, F.col("base").alias("a"), F.col("rover").alias("b"), F.col("baseline").alias("leg")))
    ends = baselines.where("not independent and base <> rover").select(one, F.col("baseline").alias("path"), F.col("rover").alias("u"), F.col("base").alias("v"))
    legs = stored(tree_paths(forest, ends))
    closed = legs.groupBy("path").agg(F.count("*").alias("n")).where("n >= 2").select(F.col("path").alias("loop"))
    back = legs.join(closed, F.col("path") == F.col("loop")).select("loop", (F.col("seq") + 1).alias("seq"), F.col("leg").alias("baseline"), "sign")
    return closed.select("loop", F.lit(0).alias("seq"), F.col("loop").alias("baseline"), F.lit(1).alias("sign")).unionByName(back)


# ---- several techniques


def combined(parts: dict[str, tuple[DataFrame, DataFrame]], tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(stations, observations) of several techniques' networks as one. A station that any holds is held, at the coordinates it has there;
    else it has those of the first technique that names it. Raises where two hold a station at different places.
    Observations carry their technique, in their names too."""
    stations = observations = None
    for place, (technique, (own, rows)) in enumerate(parts.items()):
        own = own.select("network_id", "station", "x", "y", "z", F.coalesce("fixed", F.lit(False)).alias("fixed"), F.lit(place).alias("place"))
        rows = rows.withColumn("obs", F.concat_ws(":", F.lit(technique), "obs")).withColumn("technique", F.lit(technique))
        stations = own if stations is None else stations.unionByName(own)
        observations = rows if observations is None else observations.unionByName(rows, allowMissingColumns=True)
    held = lambda f, c: f(F.when(F.col("fixed"), F.col(c)))
    apart = [F.coalesce(held(F.max, c) - held(F.min, c), F.lit(0.0)) > tolerance for c in "xyz"]
    merged = stations.groupBy("network_id", "station").agg(
        F.min_by(F.struct("x", "y", "z"), F.struct((~F.col("fixed")).alias("free"), "place")).alias("p"), F.max("fixed").alias("fixed"), (apart[0] | apart[1] | apart[2]).alias("apart")
    )
    checked = F.when(F.col("apart"), F.raise_error(F.concat(F.lit("held at two places: "), "station")).cast("boolean")).otherwise(F.col("fixed"))
    return merged.select("network_id", "station", "p.x", "p.y", "p.z", checked.alias("fixed")), observations
