"""Geoid models over many grids, and undulations as parameters of an adjustment.

cells: path, row from the south, column, value, south, west, dlat, dlon, as the readers of grids give them, in degrees and metres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Degrees of a tile of the index that tells which grids may cover a point.
TILE = 1.0
#: Standard deviation in metres of a model that states none.
SIGMA = 0.05
#: What a station's ellipsoidal height is called in a network, before the station's name.
ELLIPSOIDAL = "ellipsoidal:"
#: Redundancy below which nothing but the model tells an undulation.
UNCHECKED = 1e-6
#: Nodes of a cell and those beside it along either axis: what second differences on its sides need.
_NODES = [(i, j) for i in range(-1, 3) for j in range(-1, 3) if 0 <= i <= 1 or 0 <= j <= 1]


def coverages(cells: DataFrame) -> DataFrame:
    """(path, south, west, dlat, dlon, rows, columns) of each grid."""
    one = [F.first(c).alias(c) for c in ("south", "west", "dlat", "dlon")]
    return cells.groupBy("path").agg(*one, (F.max("row") + 1).alias("rows"), (F.max("column") + 1).alias("columns"))


def undulations(points: DataFrame, cells: DataFrame, sigmas: DataFrame | None = None) -> DataFrame:
    """Adds grid, undulation, interpolation_sigma and undulation_variance to points (latitude and longitude in degrees). Of the grids that
    cover a point the finest counts, then the first by name; outside all of them, or beside a corner without value, there is
    no undulation. Interpolation is bilinear. Its sigma is what curvature makes a bilinear surface miss: half the largest second
    difference on the sides of the cell, along each axis, times t (1 - t); the variance adds the model's own (sigmas: path, sigma).

    Grids are found by tiles and the nodes of each cell in use are joined once, whatever the number of points in it."""
    grids = coverages(cells)
    span = lambda first, n, step: F.sequence(F.floor(F.col(first) / TILE), F.floor((F.col(first) + (F.col(n) - 1) * F.col(step)) / TILE))
    tiled = grids.where("rows > 1 and columns > 1").withColumn("_ty", F.explode(span("south", "rows", "dlat"))).withColumn("_tx", F.explode(span("west", "columns", "dlon")))
    placed = points.select("latitude", "longitude").where("latitude is not null and longitude is not null").distinct()
    placed = placed.withColumns({"_ty": F.floor(F.col("latitude") / TILE), "_tx": F.floor(F.col("longitude") / TILE)})
    y, x = (F.col("latitude") - F.col("south")) / F.col("dlat"), (F.col("longitude") - F.col("west")) / F.col("dlon")
    # a point on a grid's edge is inside, whatever the division leaves behind the decimal point
    near = placed.join(tiled, ["_ty", "_tx"]).withColumns({"_y": F.round(y, 9), "_x": F.round(x, 9)})
    near = near.where("_y between 0 and rows - 1 and _x between 0 and columns - 1")
    chosen = near.groupBy("latitude", "longitude").agg(F.min_by(F.struct("path", "rows", "columns", "_y", "_x"), F.struct(F.col("dlat") * F.col("dlon"), F.col("path"))).alias("g")).select("latitude", "longitude", "g.*")
    low = lambda v, n: F.least(F.floor(v), F.col(n) - 2).cast("int")
    chosen = chosen.withColumns({"_r": low("_y", "rows"), "_c": low("_x", "columns")}).withColumns({"_y": F.col("_y") - F.col("_r"), "_x": F.col("_x") - F.col("_c")})
    nodes = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _NODES))
    asked = chosen.select("path", "_r", "_c", "rows", "columns").distinct().withColumn("n", F.explode(nodes))
    values = cells.select("path", F.col("row").alias("_row"), F.col("column").alias("_column"), "value")
    met = asked.withColumns({"_row": F.col("_r") + F.col("n.i"), "_column": F.col("_c") + F.col("n.j")}).join(values, ["path", "_row", "_column"])
    at = {(i, j): F.max(F.when((F.col("n.i") == i) & (F.col("n.j") == j), F.col("value"))).alias(f"_n{i + 1}{j + 1}") for i, j in _NODES}
    table = met.groupBy("path", "_r", "_c", "rows", "columns").agg(*at.values())
    v = lambda i, j: F.col(f"_n{i + 1}{j + 1}")

    def bend(along_rows: bool):
        """The largest second difference on the two sides of the cell along an axis, at both ends; near an edge the next line inside."""
        first, n = (F.col("_r"), F.col("rows")) if along_rows else (F.col("_c"), F.col("columns"))
        found = []
        for across in (0, 1):
            line = [v(k, across) if along_rows else v(across, k) for k in range(-1, 3)]
            lower, upper = (F.abs(line[k] - 2.0 * line[k + 1] + line[k + 2]) for k in (0, 1))
            found += [F.when(first > 0, lower).otherwise(upper), F.when(first + 1 < n - 1, upper).otherwise(lower)]
        return F.when(n >= 3, F.coalesce(F.greatest(*found), F.lit(0.0))).otherwise(0.0)

    table = table.select("path", "_r", "_c", *(v(i, j) for i in (0, 1) for j in (0, 1)), bend(True).alias("_by"), bend(False).alias("_bx"))
    share = lambda i, j: (F.col("_y") if i else 1 - F.col("_y")) * (F.col("_x") if j else 1 - F.col("_x"))
    total = sum((F.when(share(i, j) > 0, share(i, j) * v(i, j)).otherwise(0.0) for i in (0, 1) for j in (0, 1)), F.lit(0.0))
    miss = 0.5 * (F.col("_by") * F.col("_y") * (1 - F.col("_y")) + F.col("_bx") * F.col("_x") * (1 - F.col("_x")))
    found = chosen.join(table, ["path", "_r", "_c"]).select("latitude", "longitude", F.col("path").alias("grid"), total.alias("undulation"), miss.alias("interpolation_sigma"))
    own = F.lit(SIGMA)
    if sigmas is not None:
        found = found.join(sigmas.select(F.col("path").alias("grid"), F.col("sigma").alias("_own")), "grid", "left")
        own = F.coalesce("_own", F.lit(SIGMA))
    known = F.col("undulation").isNotNull()
    found = found.select("latitude", "longitude", "grid", "undulation", F.when(known, F.col("interpolation_sigma")).alias("interpolation_sigma"), F.when(known, own * own + F.col("interpolation_sigma") ** 2).alias("undulation_variance"))
    return points.join(found, ["latitude", "longitude"], "left")


def with_undulations(stations: DataFrame, observations: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations, observations) of a height network in which observations whose height_type is `ellipsoidal` are of ellipsoidal heights. Where
    they touch a station, its ellipsoidal height becomes an unknown beside its orthometric one, and the model's undulation (models:
    network_id, station, undulation, undulation_variance) an observation of their difference, so that the adjustment moves it as far
    as the other observations say. Raises, when run, where a station has no undulation."""
    is_ellipsoidal = F.coalesce(F.col("height_type"), F.lit("orthometric")) == "ellipsoidal"
    called = lambda c: F.when(is_ellipsoidal & F.col(c).isNotNull(), F.concat(F.lit(ELLIPSOIDAL), c)).otherwise(F.col(c)).alias(c)
    ends = ("at", "to")
    own = observations.select(*(called(c) if c in ends else F.col(c) for c in observations.columns if c != "height_type"))
    touched = observations.where(is_ellipsoidal).select("network_id", F.explode(F.array(*ends)).alias("station")).where("station is not null").distinct()
    known = touched.join(models, ["network_id", "station"], "left")
    value = F.when(F.col("undulation").isNotNull() & (F.col("undulation_variance") > 0), F.col("undulation")).otherwise(F.raise_error(F.concat(F.lit("no undulation at "), "station")).cast("double"))
    name = F.concat(F.lit(ELLIPSOIDAL), "station")
    kinds = dict(own.dtypes)
    given = {"network_id": F.col("network_id"), "obs": name, "type": F.lit("HEIGHT_DIFFERENCE"), "at": F.col("station"), "to": name, "value": value, "variance": F.col("undulation_variance")}
    priors = known.select(*(given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in own.columns))
    height = F.coalesce("z", F.lit(0.0)) + F.coalesce("undulation", F.lit(0.0))
    beside = known.join(stations.select("network_id", "station", "x", "y", "z"), ["network_id", "station"], "left")
    raised = beside.select("network_id", name.alias("station"), "x", "y", height.alias("z"), F.lit(False).alias("fixed"))
    return stations.select("network_id", "station", "x", "y", "z", "fixed").unionByName(raised), own.unionByName(priors)


def geoid_residuals(residuals: DataFrame, observations: DataFrame) -> DataFrame:
    """(network_id, station, model, model_std_dev, adjusted, residual, redundancy, standardised) of the undulations of an adjusted network of
    with_undulations(): one sign throughout is a bias of the model or of a height datum, a trend a tilt. Where nothing but the
    model tells an undulation, there is no standardised residual."""
    prior = F.col("obs").startswith(ELLIPSOIDAL) & (F.col("obs") == F.col("to"))
    models = observations.where(prior).select("network_id", "obs", F.col("at").alias("station"), F.col("value").alias("model"), F.sqrt("variance").alias("model_std_dev"))
    checked = (F.col("redundancy") > UNCHECKED) & F.col("residual").isNotNull()
    standard = F.try_divide(F.col("residual"), F.sqrt(F.col("redundancy") / F.col("weight")))
    rows = models.join(residuals, ["network_id", "obs"])
    return rows.select("network_id", "station", "model", "model_std_dev", (F.col("model") + F.col("residual")).alias("adjusted"), "residual", "redundancy", F.when(checked, standard).alias("standardised"))
