"""Gravimetry: calibration, reduction of readings, occupations, drift.

readings: session, instrument, station, instant timestamp, reading, variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.tides import tidal_correction


def calibrated(readings: DataFrame, calibration: DataFrame, counter: str = "counter") -> DataFrame:
    """As-of join with a table (instrument, counter, gravity, factor): the row with the greatest counter not above the
    reading's gives gravity + (reading - row) * factor. The table's rows become intervals, and intervals and readings
    are dealt to steps as wide as the instrument's widest interval, so that an equal join on the step brings
    each reading to the few intervals that may hold it; only the table is sorted. Readings outside the table keep a null
    value; the table ends one interval after its last row, and of rows with one counter the last counts."""
    rows = calibration.groupBy("instrument", "counter").agg(F.max(F.struct("gravity", "factor")).alias("r"))
    order = Window.partitionBy("instrument").orderBy("counter")
    rows = rows.select("instrument", F.col("counter").alias("low"), "r.gravity", "r.factor", F.lead("counter").over(order).alias("next"), F.lag("counter").over(order).alias("before"))
    # the last interval is as long as the one before it
    rows = rows.withColumn("high", F.coalesce("next", F.col("low") + F.coalesce(F.col("low") - F.col("before"), F.lit(0.0)))).withColumn("closed", F.col("next").isNull())
    steps = rows.groupBy("instrument").agg(F.max(F.col("high") - F.col("low")).alias("step")).withColumn("step", F.when(F.col("step") > 0, F.col("step")).otherwise(1.0))
    place = lambda c: F.floor(F.col(c) / F.col("step"))
    intervals = rows.join(steps, "instrument").withColumn("at", F.explode(F.sequence(place("low"), place("high")))).select("instrument", "at", "low", "high", "closed", "gravity", "factor")
    asked = readings.join(steps, "instrument", "left").withColumn("at", place(counter)).drop("step")
    inside = (F.col(counter) >= F.col("low")) & ((F.col(counter) < F.col("high")) | (F.col("closed") & (F.col(counter) <= F.col("high"))))
    found = asked.alias("r").join(intervals.alias("t"), (F.col("r.instrument") == F.col("t.instrument")) & (F.col("r.at") == F.col("t.at")) & inside, "left")
    return found.select(*(F.col(f"r.`{c}`") for c in readings.columns), (F.col("gravity") + (F.col(f"r.`{counter}`") - F.col("low")) * F.col("factor")).alias("value"))


def reduce_readings(readings: DataFrame, scale: float = 1.0, gradient: float = -3.086e-6, replace_tide: bool = True) -> DataFrame:
    """Scale, tide and height of the sensor above the mark: adds tide and reduced. A reading whose tide was taken off
    already (tide_applied) keeps it."""
    tide = tidal_correction(F.col("instant"), F.col("latitude"), F.col("longitude"), F.col("height")) if replace_tide else F.lit(0.0)
    tide = F.when(F.coalesce(F.col("tide_applied"), F.lit(False)), 0.0).otherwise(tide)
    return readings.withColumn("tide", tide).withColumn("reduced", F.col("reading") * scale + F.col("tide") - gradient * F.col("sensor_height"))


def duplicate_readings(readings: DataFrame) -> DataFrame:
    return readings.groupBy("session", "station", "instant").agg(F.count("*").alias("n")).where("n > 1")


def occupations(readings: DataFrame, order: list[str] | None = None, value: str = "value") -> DataFrame:
    """Visits: consecutive readings of a session at one station, weighted by their inverse variances.
    (session, visit, station, value, variance, instant, readings). A session is one instrument's tour, so its
    readings are few enough for one window."""
    w = Window.partitionBy("session").orderBy(*(order or ["instant"]))
    change = F.when(F.lag("station").over(w) == F.col("station"), 0).otherwise(1)
    visits = readings.withColumn("change", change).withColumn("visit", F.sum("change").over(w))
    weight = 1.0 / F.col("variance")
    seconds = F.unix_micros("instant") / 1e6
    return visits.groupBy("session", "visit", "station").agg(
        (F.sum(F.col(value) * weight) / F.sum(weight)).alias("value"),
        (1.0 / F.sum(weight)).alias("variance"),
        (F.sum(seconds * weight) / F.sum(weight)).alias("seconds"),
        F.count("*").alias("readings"),
    )


def mixed_sessions(readings: DataFrame) -> DataFrame:
    """Sessions with more than one instrument, which can't share one drift."""
    return readings.groupBy("session").agg(F.countDistinct("instrument").alias("instruments")).where("instruments > 1")


def successive_differences(visits: DataFrame) -> DataFrame:
    """Each visit with the next of its session: difference, variance and both times since the session began."""
    w = Window.partitionBy("session").orderBy("visit")
    start = F.first("seconds").over(w)
    nxt = lambda c: F.lead(c).over(w)
    out = visits.select(
        "session",
        "visit",
        F.col("station").alias("from"),
        nxt("station").alias("to"),
        (nxt("value") - F.col("value")).alias("difference"),
        (nxt("variance") + F.col("variance")).alias("variance"),
        (F.col("seconds") - start).alias("elapsed_from"),
        (nxt("seconds") - start).alias("elapsed_to"),
    )
    return out.where(F.col("to").isNotNull())


def base_drift(visits: DataFrame, base: Column) -> DataFrame:
    """Per session the weighted straight line through the visits at its base, in closed form, as sums:
    (session, base_visits, rate, offset). Null where the base was visited once."""
    own = visits.where(base)
    w, x, y = 1.0 / F.col("variance"), F.col("seconds") - F.col("start"), F.col("value")
    own = own.withColumn("start", F.min("seconds").over(Window.partitionBy("session")))
    s = own.groupBy("session").agg(F.count("*").alias("base_visits"), F.first("start").alias("start"), *(F.sum(e).alias(n) for n, e in (("w", w), ("wx", w * x), ("wy", w * y), ("wxx", w * x * x), ("wxy", w * x * y))))
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    rate = F.when(det > 0, (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / det)
    return s.select("session", "base_visits", "start", rate.alias("rate"), ((F.col("wy") - rate * F.col("wx")) / F.col("w")).alias("offset"))


def precorrected(visits: DataFrame, base: Column) -> DataFrame:
    """Visits other than the base's, as differences against the base's line at their time."""
    drift = base_drift(visits, base)
    joined = visits.where(~base).join(drift, "session")
    return joined.select("session", "visit", "station", (F.col("value") - (F.col("offset") + F.col("rate") * (F.col("seconds") - F.col("start")))).alias("difference"), "variance")


def compare_treatments(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two gravity solutions (station, value, variance) station by station; significant beyond three sigma."""
    a, b = first.alias("a"), second.alias("b")
    d, v = F.col("b.value") - F.col("a.value"), F.col("a.variance") + F.col("b.variance")
    return a.join(b, F.col("a.station") == F.col("b.station")).select(F.col("a.station").alias("station"), d.alias("difference"), v.alias("variance"), (F.abs(d) > 3.0 * F.sqrt(v)).alias("significant"))
