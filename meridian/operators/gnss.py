"""GNSS: sessions, quality, baselines and loops.

sessions: session, station, start, end timestamps. epochs: session, instant, status, satellites, ratio.
baselines: baseline, base, rover, dx, dy, dz and the six covariances cxx cxy cxz cyy cyz czz."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.geodesy import enu_rotation
from meridian.functions.uncertainty import transform

COVARIANCES = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def overlap_groups(sessions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Groups of sessions whose spans overlap, over any chain of overlaps; touching ends do not overlap, and a session without
    a span is a group of its own. Numbers start at 1 within `by`."""
    keys = by or []
    known = F.col("start").isNotNull() & F.col("end").isNotNull()
    w = Window.partitionBy(*keys).orderBy("start", "end", "session")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = sessions.where(known).withColumn("new", F.when(reach > F.col("start"), 0).otherwise(1))
    spans = spans.withColumn("group", F.sum("new").over(w)).drop("new")
    return spans.unionByName(sessions.where(~known).withColumn("group", F.lit(None).cast("long")))


def occupations(files: DataFrame, gap_seconds: float = 60.0) -> DataFrame:
    """Files of one station that continue one occupation: same setup, and a gap of at most the larger of `gap_seconds` and twice the
    recording interval."""
    w = Window.partitionBy("station").orderBy("start", "end", "session")
    gap = (F.unix_micros("start") - F.unix_micros(F.lag("end").over(w))) / 1e6
    same = F.lag("setup").over(w).eqNullSafe(F.col("setup"))
    new = F.when(same & (gap <= F.greatest(F.lit(gap_seconds), 2.0 * F.col("interval"))), 0).otherwise(1)
    return files.withColumn("new", new).withColumn("occupation", F.sum("new").over(w)).drop("new")


def session_summary(epochs: DataFrame, fixed: list[str]) -> DataFrame:
    """One row a session: epochs, fixed fraction, satellites, ratio, and the median gap between epochs in seconds."""
    w = Window.partitionBy("session").orderBy("instant")
    gap = (F.unix_micros(F.lead("instant").over(w)) - F.unix_micros("instant")) / 1e6
    return epochs.withColumn("gap", gap).groupBy("session").agg(
        F.count("*").alias("epochs"),
        F.avg(F.when(F.col("status").isin(*fixed), 1.0).otherwise(0.0)).alias("fixed_fraction"),
        F.min("satellites").alias("least_satellites"),
        F.max("satellites").alias("most_satellites"),
        F.max("ratio").alias("best_ratio"),
        F.median("ratio").alias("median_ratio"),
        F.median("gap").alias("median_gap"),
    )


def status_counts(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("session", "status").agg(F.count("*").alias("epochs"))


def dilution_of_precision(sightings: DataFrame, mask: float = 0.0) -> DataFrame:
    """(session, instant, satellites, gdop, pdop, hdop, vdop) from azimuths and elevations in radians: the ten sums of an epoch's
    normal matrix are native, and only the 4 x 4 inverses run in NumPy, a batch of epochs at a time."""
    e, az = F.col("elevation"), F.col("azimuth")
    row = [F.cos(e) * F.sin(az), F.cos(e) * F.cos(az), F.sin(e), F.lit(1.0)]
    sums = [F.sum(row[i] * row[j]).alias(f"n{i}{j}") for i in range(4) for j in range(i, 4)]
    epochs = sightings.where(e >= mask).groupBy("session", "instant").agg(F.count("*").alias("satellites"), *sums)

    @F.pandas_udf("gdop double, pdop double, hdop double, vdop double")
    def invert(satellites: pd.Series, *entries: pd.Series) -> pd.DataFrame:
        n = np.zeros((len(satellites), 4, 4))
        k = iter(entries)
        for i in range(4):
            for j in range(i, 4):
                n[:, i, j] = n[:, j, i] = next(k)
        out = np.full((len(n), 4), np.nan)
        good = (satellites.to_numpy() >= 4) & (np.linalg.cond(n) < 1e12)
        if good.any():
            q = np.maximum(np.diagonal(np.linalg.inv(n[good]), axis1=1, axis2=2), 0)
            out[good] = np.sqrt(np.stack([q.sum(1), q[:, :3].sum(1), q[:, :2].sum(1), q[:, 2]], axis=1))
        return pd.DataFrame(out, columns=["gdop", "pdop", "hdop", "vdop"]).replace({np.nan: None})

    dop = invert("satellites", *(f"n{i}{j}" for i in range(4) for j in range(i, 4)))
    return epochs.withColumn("dop", dop).select("session", "instant", "satellites", "dop.*")


def covariance_matrix(prefix: str = "") -> list[list[Column]]:
    c = {k: F.col(f"{prefix}{k}") for k in COVARIANCES}
    return [[c["cxx"], c["cxy"], c["cxz"]], [c["cxy"], c["cyy"], c["cyz"]], [c["cxz"], c["cyz"], c["czz"]]]


def to_local(baselines: DataFrame) -> DataFrame:
    """Adds east, north, up and their covariances at the base (latitude, longitude)."""
    r = enu_rotation(F.col("latitude"), F.col("longitude"))
    vector = [F.col("dx"), F.col("dy"), F.col("dz")]
    enu = {n: r[i][0] * vector[0] + r[i][1] * vector[1] + r[i][2] * vector[2] for i, n in enumerate(("east", "north", "up"))}
    s = transform(r, covariance_matrix())
    names = [(0, 0, "cee"), (0, 1, "cen"), (0, 2, "ceu"), (1, 1, "cnn"), (1, 2, "cnu"), (2, 2, "cuu")]
    return baselines.withColumns(enu | {n: s[i][j] for i, j, n in names})


def oriented(baselines: DataFrame) -> DataFrame:
    """All determinations of a pair in one direction, from its smaller station."""
    turn = F.when(F.col("base") <= F.col("rover"), 1.0).otherwise(-1.0)
    return baselines.withColumns({"a": F.least("base", "rover"), "b": F.greatest("base", "rover"), **{c: turn * F.col(c) for c in ("dx", "dy", "dz")}})


def repeatability(baselines: DataFrame) -> DataFrame:
    """Departures of each determination from the mean of its pair, where there are two at least."""
    w = Window.partitionBy("a", "b")
    rows = oriented(baselines).withColumn("determinations", F.count("*").over(w))
    return rows.where("determinations > 1").select("a", "b", "baseline", "determinations", *((F.col(c) - F.avg(c).over(w)).alias(f"departure_{c[1]}") for c in ("dx", "dy", "dz")))


def loop_closure(legs: DataFrame) -> DataFrame:
    """legs: loop, sign with the baseline's columns. Misclosure, its variances, and the perimeter."""
    signed = [F.sum(F.col("sign") * F.col(c)).alias(f"m{c[1]}") for c in ("dx", "dy", "dz")]
    length = F.sum(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)).alias("perimeter")
    sums = legs.groupBy("loop").agg(*signed, *(F.sum(c).alias(c) for c in COVARIANCES), length)
    size = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    return sums.withColumn("misclosure", size).withColumn("ppm", 1e6 * size / F.col("perimeter"))


def mahalanobis3(d: list[Column], s: list[list[Column]]) -> Column:
    """d' S^-1 d of three dimensions, by cofactors."""
    c = lambda i, j: s[(i + 1) % 3][(j + 1) % 3] * s[(i + 2) % 3][(j + 2) % 3] - s[(i + 1) % 3][(j + 2) % 3] * s[(i + 2) % 3][(j + 1) % 3]
    det = s[0][0] * c(0, 0) + s[0][1] * c(0, 1) + s[0][2] * c(0, 2)
    total = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            total = total + d[i] * c(j, i) * d[j]
    return total / det


def compare_configurations(baselines: DataFrame, reference: str, critical: float) -> DataFrame:
    """Each configuration of a pair against the reference one: d' (Sa + Sb)^-1 d against a chi-square of three."""
    keep = ["base", "rover", "dx", "dy", "dz", *COVARIANCES]
    ref = baselines.where(F.col("configuration") == reference).select(*(F.col(c).alias(c if c in ("base", "rover") else f"r_{c}") for c in keep))
    joined = baselines.where(F.col("configuration") != reference).join(ref, ["base", "rover"])
    d = [F.col(c) - F.col(f"r_{c}") for c in ("dx", "dy", "dz")]
    a, b = covariance_matrix(), covariance_matrix("r_")
    chi2 = mahalanobis3(d, [[a[i][j] + b[i][j] for j in range(3)] for i in range(3)])
    return joined.select("base", "rover", "configuration", *(x.alias(f"d{n}") for x, n in zip(d, "xyz", strict=True)), F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2).alias("distance"), chi2.alias("chi2")).withColumn("significant", F.col("chi2") > critical)


def days_of(spans: DataFrame) -> DataFrame:
    """Every calendar day that a span touches."""
    return spans.select(F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("day")).distinct()
