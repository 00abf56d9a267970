"""Monitoring over epochs: comparison, congruency, series and velocities, strain, alerts.

solutions: solution, epoch (decimal year), station, x, y, z and variances vx, vy, vz; with dof and factor of the solution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import distributions as dist

AXES = ("x", "y", "z")
#: What two solutions must have alike to be compared.
COMPARED = ("frame", "datum", "height_type", "geoid", "ellipsoid", "coordinate_system")


def require_comparable(first: DataFrame, second: DataFrame, fields: tuple[str, ...] = COMPARED) -> None:
    """Raises where two solutions' descriptions (a row each) differ."""
    a, b = first.head(2), second.head(2)
    if len(a) != 1 or len(b) != 1:
        raise ValueError("a solution needs one description")
    unlike = [f for f in fields if f in first.columns and f in second.columns and a[0][f] != b[0][f]]
    if unlike:
        raise ValueError(f"solutions differ in {', '.join(unlike)}")


def compare(first: DataFrame, second: DataFrame, descriptions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Stations of both epochs: differences, and cofactors under the pooled variance factor, which is 1 without degrees of
    freedom. The epochs are taken as independent. A station that comes twice in an epoch fails; so do epochs whose `descriptions`
    (a row each, as solutions.require_comparable() reads them) state different frames, units or datums."""
    if descriptions is not None:
        require_comparable(*descriptions)
    a, b = first.alias("a"), second.alias("b")
    dof = F.col("a.dof") + F.col("b.dof")
    pooled = F.when(dof > 0, (F.col("a.dof") * F.col("a.factor") + F.col("b.dof") * F.col("b.factor")) / dof).otherwise(1.0)
    d = [(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"d{c}") for c in AXES]
    q = [(F.col(f"a.v{c}") / F.col("a.factor") + F.col(f"b.v{c}") / F.col("b.factor")).alias(f"q{c}") for c in AXES]
    both = a.join(b, F.col("a.station") == F.col("b.station")).select(F.col("a.station").alias("station"), *d, *q, pooled.alias("pooled"), dof.alias("dof"))
    again = F.count(F.lit(1)).over(Window.partitionBy("station")) > 1
    message = F.concat(F.lit("station "), F.col("station").cast("string"), F.lit(" comes twice in an epoch"))
    kind = both.schema["station"].dataType
    return both.withColumn("station", F.when(again, F.raise_error(message).cast(kind)).otherwise(F.col("station")))


def unmatched(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stations of one epoch only, and which."""
    a, b = first.select("station", F.lit(True).alias("one")), second.select("station", F.lit(True).alias("two"))
    return a.join(b, "station", "full_outer").where("one is null or two is null").select("station", F.when(F.col("one"), "first").otherwise("second").alias("epoch"))


def to_reference(comparison: DataFrame, by: list[str] | None = None, reference: str = "is_reference") -> DataFrame:
    """Differences in the datum of the reference stations: less their mean (translations)."""
    w = Window.partitionBy(*(by or []))
    return comparison.withColumns({f"d{c}": F.col(f"d{c}") - F.avg(F.when(F.col(reference), F.col(f"d{c}"))).over(w) for c in AXES})


def congruency(comparison: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Omega = d'Q^-1 d of each block with diagonal cofactors, against F(h, dof), or chi-square(h) without dof."""
    omega = sum((F.col(f"d{c}") ** 2 / F.col(f"q{c}") for c in AXES[1:]), F.col("dx") ** 2 / F.col("qx"))
    block = comparison.groupBy(*by).agg(F.sum(omega).alias("omega"), (3 * F.count("*")).alias("h"), F.first("pooled").alias("pooled"), F.first("dof").alias("dof"))
    pairs = [(r.h, r.dof) for r in block.select("h", "dof").distinct().collect()]
    rows = [(int(h), int(f), dist.f_quantile(confidence, h, f) if f > 0 else dist.chi2_quantile(confidence, h)) for h, f in pairs]
    critical = comparison.sparkSession.createDataFrame(rows, "h long, dof long, critical double")
    joined = block.withColumns({"h": F.col("h").cast("long"), "dof": F.col("dof").cast("long")}).join(critical, ["h", "dof"])
    statistic = F.when(F.col("dof") > 0, F.col("omega") / (F.col("h") * F.col("pooled"))).otherwise(F.col("omega"))
    return joined.withColumn("statistic", statistic).withColumn("congruent", F.col("statistic") <= F.col("critical"))


def displacements(comparison: DataFrame, critical: float) -> DataFrame:
    """Per station: size, plan size, statistic against a chi-square of three, significance."""
    t = sum((F.col(f"d{c}") ** 2 / (F.col(f"q{c}") * F.col("pooled")) for c in AXES[1:]), F.col("dx") ** 2 / (F.col("qx") * F.col("pooled")))
    return comparison.withColumns({"horizontal": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2), "magnitude": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2), "statistic": t, "significant": t > critical})


def series(solutions: DataFrame) -> DataFrame:
    """Offsets of each station from its first epoch."""
    w = Window.partitionBy("station").orderBy("epoch")
    return solutions.select("station", "epoch", *((F.col(c) - F.first(c).over(w)).alias(f"o{c}") for c in AXES), *(f"v{c}" for c in AXES))


def velocities(solutions: DataFrame) -> DataFrame:
    """Weighted straight line of each component and station, on time centred at the mean epoch: velocity, variance and the statistic
    of no motion. Sums only, so a station may have any number of epochs. Null with one epoch."""
    mean = solutions.groupBy("station").agg(F.avg("epoch").alias("t0"), F.count("*").alias("epochs"))
    rows = solutions.join(mean, "station").withColumn("t", F.col("epoch") - F.col("t0"))
    sums = [F.sum(e / F.col(f"v{c}")).alias(f"{n}{c}") for c in AXES for n, e in (("w", F.lit(1.0)), ("s", F.col("t")), ("ss", F.col("t") ** 2), ("l", F.col(c)), ("sl", F.col("t") * F.col(c)))]
    out = rows.groupBy("station").agg(F.first("epochs").alias("epochs"), *sums)
    for c in AXES:
        det = F.col(f"w{c}") * F.col(f"ss{c}") - F.col(f"s{c}") ** 2
        good = (F.col("epochs") > 1) & (det > 0)
        out = out.withColumns({f"velocity_{c}": F.when(good, (F.col(f"w{c}") * F.col(f"sl{c}") - F.col(f"s{c}") * F.col(f"l{c}")) / det), f"velocity_{c}_variance": F.when(good, F.col(f"w{c}") / det)})
    statistic = sum((F.col(f"velocity_{c}") ** 2 / F.col(f"velocity_{c}_variance") for c in AXES[1:]), F.col("velocity_x") ** 2 / F.col("velocity_x_variance"))
    return out.select("station", "epochs", *(f"velocity_{c}{v}" for c in AXES for v in ("", "_variance")), statistic.alias("statistic"))


def strain(displaced: DataFrame, by: list[str]) -> DataFrame:
    """Plane strain of blocks of stations (x, y, dx, dy): affine gradients on centred coordinates, from five sums; rotation, dilatation,
    shear and principal strains. Null for collinear stations or fewer than three."""
    w = Window.partitionBy(*by)
    rows = displaced.withColumns({n: F.col(c) - F.avg(c).over(w) for n, c in (("cx", "x"), ("cy", "y"), ("ux", "dx"), ("uy", "dy"))})
    p = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}")
    s = rows.groupBy(*by).agg(F.count("*").alias("stations"), p("cx", "cx"), p("cx", "cy"), p("cy", "cy"), p("cx", "ux"), p("cy", "ux"), p("cx", "uy"), p("cy", "uy"))
    det = F.col("cxcx") * F.col("cycy") - F.col("cxcy") ** 2
    good = (F.col("stations") >= 3) & (det > 1e-9 * F.col("cxcx") * F.col("cycy"))
    grad = lambda a, b: F.when(good, (F.col(a) * F.col("cycy") - F.col(b) * F.col("cxcy")) / det)
    grad2 = lambda a, b: F.when(good, (F.col(b) * F.col("cxcx") - F.col(a) * F.col("cxcy")) / det)
    s = s.withColumns({"a11": grad("cxux", "cyux"), "a12": grad2("cxux", "cyux"), "a21": grad("cxuy", "cyuy"), "a22": grad2("cxuy", "cyuy")})
    exy = (F.col("a12") + F.col("a21")) / 2.0
    shear = F.sqrt((F.col("a11") - F.col("a22")) ** 2 + 4.0 * exy * exy)
    return s.select(*by, "stations", ((F.col("a21") - F.col("a12")) / 2.0).alias("rotation"), (F.col("a11") + F.col("a22")).alias("dilatation"), shear.alias("shear"), ((F.col("a11") + F.col("a22") + shear) / 2.0).alias("largest"), ((F.col("a11") + F.col("a22") - shear) / 2.0).alias("smallest"))


#: What thresholds can be on.
THRESHOLD_KINDS = ("magnitude", "horizontal", "vertical", "velocity")


def alerts(thresholds: DataFrame, moved: DataFrame) -> DataFrame:
    """Thresholds (threshold, kind, limit, stations array or null for all) crossed by stations, strictly. Each displacement becomes one row a
    kind, so thresholds meet rows of their own kind only; a list of thresholds is a person's, so Spark broadcasts it where it
    is small."""
    values = {"magnitude": F.col("magnitude"), "horizontal": F.col("horizontal"), "vertical": F.abs("dz")}
    if "velocity" in moved.columns:
        values["velocity"] = F.col("velocity")
    long = moved.select("station", F.explode(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("double"))))).alias("kind", "value"))
    named = F.col("stations").isNull() | F.array_contains("stations", F.col("station"))
    return thresholds.join(long, "kind").where(named & (F.col("value") > F.col("limit"))).select("threshold", "station", "kind", "value", "limit")


def station_category(moved: DataFrame, crossed: DataFrame) -> DataFrame:
    """alert, significant or none, with the sorted kinds that were crossed."""
    kinds = crossed.groupBy("station").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    joined = moved.join(kinds, "station", "left")
    return joined.select("station", F.when(F.col("kinds").isNotNull(), "alert").when(F.col("significant"), "significant").otherwise("none").alias("category"), "kinds")


def unstable_reference(block: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Greedy localisation: while a block of reference stations (block keys, station, dx.., qx.., pooled, dof) is not congruent, the station
    with the largest share leaves. (keys, step, station, share, statistic, critical). A block is one object's few reference stations."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out, rows, step = [], rows.copy(), 0
        pooled, dof = float(rows.pooled.iloc[0]), int(rows.dof.iloc[0])
        while len(rows) > 1:
            d = rows[["dx", "dy", "dz"]].to_numpy() - rows[["dx", "dy", "dz"]].to_numpy().mean(axis=0)
            share = (d * d / rows[["qx", "qy", "qz"]].to_numpy()).sum(axis=1)
            h = 3 * (len(rows) - 1)
            statistic = share.sum() / (h * pooled) if dof > 0 else share.sum()
            critical = dist.f_quantile(confidence, h, dof) if dof > 0 else dist.chi2_quantile(confidence, h)
            if statistic <= critical:
                break
            worst = int(np.argmax(share))
            out.append((*rows[by].iloc[0], step, rows.station.iloc[worst], share[worst], statistic, critical))
            rows, step = rows.drop(rows.index[worst]), step + 1
        return pd.DataFrame(out, columns=[*by, "step", "station", "share", "statistic", "critical"])

    kinds = dict(block.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", step int, station string, share double, statistic double, critical double"
    return block.groupBy(*by).applyInPandas(one, schema)


def ring(x: Column, y: Column, semi_major: Column, semi_minor: Column, azimuth: Column, exaggeration: float = 1.0, vertices: int = 36) -> Column:
    """A closed ring of an exaggerated ellipse as array<struct<x, y>>."""
    t = lambda k: k * (2.0 * np.pi / vertices)
    a, b = exaggeration * semi_major, exaggeration * semi_minor
    point = lambda k: F.struct(
        (x + a * F.cos(t(k)) * F.sin(azimuth) + b * F.sin(t(k)) * F.cos(azimuth)).alias("x"),
        (y + a * F.cos(t(k)) * F.cos(azimuth) - b * F.sin(t(k)) * F.sin(azimuth)).alias("y"),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), point)


def nice_factor(value: Column) -> Column:
    """The largest 1, 2 or 5 times a power of ten not above the value; 1 at least."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    first = value / power
    return F.when(value < 1, F.lit(1.0)).otherwise(power * F.when(first >= 5, 5.0).when(first >= 2, 2.0).otherwise(1.0))
