"""Starting coordinates of plane networks, out of their observations.

Distances and azimuths of one pair of stations are vectors, which are carried from known stations all at once
(network.carried_values). What is left is placed by a frontier: in a round, a station is placed from stations that are placed by
then, by polar survey, by the best of its intersections, or by distances to three at least. Sums and joins only; a station
may have any number of observations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.angles import circular_mean
from meridian.operators.network import carried_values
from meridian.sources.shared import discard, stored

#: Sine of the angle at which two lines of sight cross, below which they give no place, and the same for distances' normal matrix.
FLAT = 0.02


def vectors(observations: DataFrame) -> DataFrame:
    """(network_id, a, b, d_x, d_y): one vector for each pair with a distance and an azimuth, or with both coordinate differences."""
    turn = F.col("at") > F.col("to")
    pair = observations.where("at is not null and to is not null and at <> to").select(
        "network_id", F.least("at", "to").alias("a"), F.greatest("at", "to").alias("b"), "type", "value", F.when(turn, -1.0).otherwise(1.0).alias("sign")
    )
    of = lambda kind, v: F.when(F.col("type") == kind, v)
    azimuth = F.col("value") + F.when(F.col("sign") < 0, math.pi).otherwise(0.0)
    sums = pair.groupBy("network_id", "a", "b").agg(
        F.avg(of("HORIZONTAL_DISTANCE", F.col("value"))).alias("d"),
        F.sum(of("AZIMUTH", F.sin(azimuth))).alias("s"),
        F.sum(of("AZIMUTH", F.cos(azimuth))).alias("c"),
        *(F.avg(of(f"{k.upper()}_DIFFERENCE", F.col("value") * F.col("sign"))).alias(k) for k in "xy"),
    )
    norm = F.sqrt(F.col("s") ** 2 + F.col("c") ** 2)
    x, y = (F.coalesce(k, F.try_divide(F.col("d") * F.col(p), norm)) for k, p in (("x", "s"), ("y", "c")))
    return sums.select("network_id", "a", "b", x.alias("d_x"), y.alias("d_y")).where("d_x is not null and d_y is not null")


def _sights(observations: DataFrame, placed: DataFrame) -> DataFrame:
    """(network_id, station, x, y, azimuth, distance): lines from placed stations to stations that are not, each with what is observed of
    it. Directions are oriented by the placed targets of their setup."""
    here = placed.select("network_id", F.col("station").alias("at"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    there = placed.select("network_id", F.col("station").alias("to"), F.col("x").alias("bx"), F.col("y").alias("by"))
    rows = observations.where(F.col("type").isin("HORIZONTAL_DISTANCE", "AZIMUTH", "DIRECTION")).join(here, ["network_id", "at"], "left").join(there, ["network_id", "to"], "left")
    seen = F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    turned = rows.where("type = 'DIRECTION' and ax is not null and bx is not null").groupBy("network_id", "setup").agg(circular_mean(seen - F.col("value")).alias("turn"))
    rows = rows.where("(ax is null) <> (bx is null)").join(turned, ["network_id", "setup"], "left")
    forth = F.col("bx").isNull()
    reading = F.when(F.col("type") == "AZIMUTH", F.col("value")).when(F.col("type") == "DIRECTION", F.col("value") + F.col("turn"))
    one = rows.select(
        "network_id",
        F.when(forth, F.col("to")).otherwise(F.col("at")).alias("station"),
        F.when(forth, F.col("at")).otherwise(F.col("to")).alias("from"),
        F.when(forth, F.col("ax")).otherwise(F.col("bx")).alias("x"),
        F.when(forth, F.col("ay")).otherwise(F.col("by")).alias("y"),
        F.when(forth, reading).when(F.col("type") == "AZIMUTH", F.col("value") + math.pi).alias("azimuth"),
        F.when(F.col("type") == "HORIZONTAL_DISTANCE", F.col("value")).alias("distance"),
    )
    line = one.groupBy("network_id", "station", "from").agg(F.first("x").alias("x"), F.first("y").alias("y"), circular_mean(F.col("azimuth")).alias("azimuth"), F.count("azimuth").alias("n"), F.avg("distance").alias("distance"))
    return line.select("network_id", "station", "from", "x", "y", F.when(F.col("n") > 0, F.col("azimuth")).alias("azimuth"), "distance").where("azimuth is not null or distance is not null")


def _by_distances() -> list[Column]:
    """Place and flatness by x^2 + y^2 - 2 x x_i - 2 y y_i = d_i^2 - x_i^2 - y_i^2, less its mean: two unknowns out of sums."""
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    own = F.col("distance").isNotNull()
    q = x * x + y * y - F.col("distance") ** 2
    s = lambda e: F.sum(F.when(own, e))
    n = F.count(F.when(own, 1))
    xx, xy, yy = s(x * x), s(x * y), s(y * y)
    xq, yq = s(x * (q - F.col("mq"))) / 2.0, s(y * (q - F.col("mq"))) / 2.0
    det = xx * yy - xy * xy
    return [n.alias("n_distances"), F.try_divide(det, (xx + yy) * (xx + yy)).alias("spread"), F.try_divide(yy * xq - xy * yq, det).alias("tx"), F.try_divide(xx * yq - xy * xq, det).alias("ty"), F.first("mx").alias("mx"), F.first("my").alias("my")]


def _placed_now(sights: DataFrame) -> DataFrame:
    """(network_id, station, x, y): polar where one line has both; else the intersection of a line with the one that crosses it best; else
    by distances."""
    keys = ["network_id", "station"]
    both = F.col("azimuth").isNotNull() & F.col("distance").isNotNull()
    polar = [F.avg(F.when(both, F.col(c) + F.col("distance") * f(F.col("azimuth")))).alias(f"p{c}") for c, f in (("x", F.sin), ("y", F.cos))]
    first = F.min_by(F.struct("x", "y", "azimuth"), F.when(F.col("azimuth").isNotNull(), F.col("from"))).alias("first")
    known = F.when(F.col("distance").isNotNull(), F.lit(1))
    centre = [F.avg(F.when(known.isNotNull(), F.col(c))).alias(f"m{c}") for c in "xy"]
    heads = sights.groupBy(*keys).agg(*polar, first, *centre)
    rows = sights.join(heads, keys)
    q = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 - F.col("distance") ** 2
    means = rows.groupBy(*keys).agg(F.avg(q).alias("mq"))
    rows = rows.join(means, keys)
    cross = F.sin(F.col("azimuth") - F.col("first.azimuth"))
    along = F.try_divide((F.col("x") - F.col("first.x")) * F.cos("azimuth") - (F.col("y") - F.col("first.y")) * F.sin("azimuth"), -cross)
    best = F.max_by(F.struct(F.abs(cross).alias("cross"), (F.col("first.x") + along * F.sin("first.azimuth")).alias("x"), (F.col("first.y") + along * F.cos("first.azimuth")).alias("y")), F.abs(cross)).alias("meet")
    out = rows.groupBy(*keys).agg(F.first("px").alias("px"), F.first("py").alias("py"), best, *_by_distances())
    crossing = F.col("meet.cross") >= FLAT
    spread = (F.col("n_distances") >= 3) & (F.col("spread") >= FLAT * FLAT)
    place = [F.coalesce(f"p{c}", F.when(crossing, F.col(f"meet.{c}")), F.when(spread, F.col(f"m{c}") + F.col(f"t{c}"))).alias(c) for c in "xy"]
    return out.select(*keys, *place).where("x is not null and y is not null")


def starting_positions(stations: DataFrame, observations: DataFrame) -> DataFrame:
    """(network_id, station, x, y, round): known coordinates (both not null) as they are, in round 0, what vectors carry from them in round
    0 too, and then what the frontier reaches. Stations that observations do not place have nulls."""
    known = stations.where("x is not null and y is not null").select("network_id", "station", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    observations = stored(observations.select("network_id", "type", "at", "to", "setup", "value"))
    carried = carried_values(known, vectors(observations), ("x", "y"))
    placed = stored(known.unionByName(carried.join(known, ["network_id", "station"], "left_anti")).withColumn("round", F.lit(0)))
    n = 0
    while True:
        n += 1
        new = stored(_placed_now(_sights(observations, placed)).withColumn("round", F.lit(n)))
        if new.isEmpty():
            break
        more = stored(placed.unionByName(new))
        discard(placed, new)
        placed = more
    return stations.select("network_id", "station").distinct().join(placed, ["network_id", "station"], "left")
