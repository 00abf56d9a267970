"""Frames: positions brought from one frame to another at their own epochs, along the shortest way over the transformations that are held.

transformations: source, target, code, epoch (decimal year of the parameters), tx, ty, tz (metres), scale, rx, ry, rz (radians, of the position-vector
convention), and rates a year of each (d_tx ...), accuracy (metres). Frames are some dozen, so their ways to each other
are a small table, made once; a position meets its way by a join and is folded over its legs natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMETERS = ("tx", "ty", "tz", "scale", "rx", "ry", "rz")
#: Legs of a way at most; frames that are further apart are not joined.
LEGS = 8


def _legs(transformations: DataFrame) -> DataFrame:
    """(a, b, leg): each transformation in both directions."""
    kept = ["code", "epoch", "accuracy", *PARAMETERS, *(f"d_{p}" for p in PARAMETERS)]
    way = lambda a, b, back: transformations.select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c not in ("code",) else F.col(c) for c in kept), F.lit(back).alias("inverse")).alias("leg"))
    return way("source", "target", False).unionByName(way("target", "source", True))


def frame_paths(transformations: DataFrame) -> DataFrame:
    """(source, target, legs): the shortest way between any two frames, so that a published direct transformation comes before a composition; of
    ways of one length, the one whose codes come first."""
    legs = _legs(transformations)
    paths = legs.groupBy("a", "b").agg(F.min_by("leg", F.col("leg.code")).alias("leg")).select(F.col("a").alias("source"), F.col("b").alias("target"), F.array("leg").alias("legs"))
    step = paths.select(F.col("source").alias("target"), F.col("target").alias("end"), F.col("legs").alias("more"))
    known = paths
    for n in range(2, LEGS + 1):
        longer = known.where(F.size("legs") == n - 1).join(step, "target").where("source <> end").select("source", F.col("end").alias("target"), F.concat("legs", "more").alias("legs"))
        best = longer.groupBy("source", "target").agg(F.min_by("legs", F.transform("legs", lambda x: x["code"])).alias("legs"))
        new = best.join(known.select("source", "target"), ["source", "target"], "left_anti")
        rows = new.collect()  # at most a row for each pair of frames
        if not rows:
            break
        known = known.unionByName(transformations.sparkSession.createDataFrame(rows, new.schema))
    return known


def _forth(p: Column, leg: Column, epoch: Column, inverse: bool) -> tuple[Column, Column, Column]:
    """X' = T + ((1 + s) I + K) X, as geodesy.Helmert has it, with the parameters at an epoch; or the way back, by the exact inverse of that matrix."""
    years = epoch - leg["epoch"]
    tx, ty, tz, s, rx, ry, rz = (leg[k] + years * leg[f"d_{k}"] for k in PARAMETERS)
    x, y, z = p["x"], p["y"], p["z"]
    k = 1 + s
    if not inverse:
        return tx + k * x - rz * y + ry * z, ty + rz * x + k * y - rx * z, tz - ry * x + rx * y + k * z
    u, v, w = x - tx, y - ty, z - tz
    # the inverse of k I + K for the antisymmetric K of r = (rx, ry, rz): (k^2 I - k K + r r') / (k (k^2 + r'r))
    dot, size = rx * u + ry * v + rz * w, k * (k * k + rx * rx + ry * ry + rz * rz)
    return (k * (k * u + rz * v - ry * w) + rx * dot) / size, (k * (k * v - rz * u + rx * w) + ry * dot) / size, (k * (k * w + ry * u - rx * v) + rz * dot) / size


def transformed(positions: DataFrame, transformations: DataFrame) -> DataFrame:
    """positions (any columns, with x, y, z, epoch, source, target) in their target frames, with status, codes of the legs (with - before those taken
    backwards) and accuracy, the root of the sum of the legs' squares: it is common to all points, so it is not added to variances. The
    legs' parameters are those of each position's own epoch. Where no way is held, the status is `unavailable` and coordinates are null."""
    paths = frame_paths(transformations)
    rows = positions.join(F.broadcast(paths), ["source", "target"], "left")  # pairs of frames
    same = F.col("source") == F.col("target")
    begin = F.struct(*(F.col(c).cast("double").alias(c) for c in "xyz"))

    def fold(at: Column, leg: Column) -> Column:
        back, on = _forth(at, leg, F.col("epoch"), True), _forth(at, leg, F.col("epoch"), False)
        return F.struct(*(F.when(leg["inverse"], b).otherwise(o).alias(c) for c, b, o in zip("xyz", back, on, strict=True)))

    moved = F.aggregate(F.coalesce("legs", F.array().cast(paths.schema["legs"].dataType)), begin, fold)
    known = same | F.col("legs").isNotNull()
    own = [c for c in positions.columns if c not in "xyz"]
    codes = F.transform("legs", lambda x: F.concat(F.when(x["inverse"], "-").otherwise(""), x["code"]))
    square = F.aggregate(F.transform("legs", lambda x: x["accuracy"] * x["accuracy"]), F.lit(0.0), lambda a, b: a + b)
    out = rows.withColumn("_p", moved)
    return out.select(
        *own, *(F.when(known, F.col(f"_p.{c}")).alias(c) for c in "xyz"), F.when(known, "transformed").otherwise("unavailable").alias("status"),
        F.coalesce(codes, F.array().cast("array<string>")).alias("codes"), F.when(known, F.sqrt(F.coalesce(square, F.lit(0.0)))).alias("accuracy"),
    )
