"""Levelling: readings, setups, lines, closures and orthometric corrections.

setups: line, seq, setup, from, to, backsight, foresight, backsight_distance, foresight_distance, variances of both readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gravity flattening of the normal orthometric correction, and R in metres.
GRAVITY_FLATTENING, EARTH_RADIUS = 0.0053024, 6371000.0


def three_wire(upper: Column, middle: Column, lower: Column, variance: Column, factor: float = 100.0) -> dict[str, Column]:
    """Reading, variance, half-sum check and distance of three stadia wires; null unless lower < middle < upper."""
    ordered = (lower < middle) & (middle < upper)
    own = lambda c: F.when(ordered, c)
    return {
        "reading": own((upper + middle + lower) / 3.0),
        "variance": own(variance / 3.0),
        "half_sum": own((upper + lower) / 2.0 - middle),
        "distance": own(factor * (upper - lower)),
    }


def reduce_setups(setups: DataFrame, collimation: float = 0.0, collimation_variance: float = 0.0, max_sight: float = 0.0, max_imbalance: float = 0.0) -> DataFrame:
    """Adds height_difference, variance, imbalance and flags; the collimation acts on the difference of sight lengths."""
    imbalance = F.col("backsight_distance") - F.col("foresight_distance")
    return setups.withColumns({
        "imbalance": imbalance,
        "height_difference": F.col("backsight") - F.col("foresight") - collimation * imbalance,
        "variance": F.col("backsight_variance") + F.col("foresight_variance") + imbalance * imbalance * collimation_variance,
        "long_sight": F.lit(max_sight > 0) & (F.greatest("backsight_distance", "foresight_distance") > max_sight),
        "unbalanced": F.lit(max_imbalance > 0) & (F.abs(imbalance) > max_imbalance),
    })


def foresight_covariances(sights: DataFrame, collimation_variance: float = 0.0) -> DataFrame:
    """(setup, first, second, covariance) of the differences to a setup's foresights, which share backsight and collimation.
    sights: setup, target, imbalance, backsight_variance, foresight_variance. A self-join within a setup, whose
    foresights are what one instrument station can see."""
    a, b = sights.alias("a"), sights.alias("b")
    same = F.when(F.col("a.target") == F.col("b.target"), F.col("a.foresight_variance")).otherwise(0.0)
    shared = F.col("a.backsight_variance") + F.col("a.imbalance") * F.col("b.imbalance") * collimation_variance
    return a.join(b, F.col("a.setup") == F.col("b.setup")).where(F.col("a.target") <= F.col("b.target")).select(F.col("a.setup").alias("setup"), F.col("a.target").alias("first"), F.col("b.target").alias("second"), (shared + same).alias("covariance"))


def reduce_lines(setups: DataFrame, collimation: float = 0.0, collimation_variance: float = 0.0) -> DataFrame:
    """One row a line: the collimation is one unknown of the whole line, so its variance goes with the square of the
    accumulated imbalance."""
    imbalance = F.col("backsight_distance") - F.col("foresight_distance")
    sums = setups.groupBy("line").agg(
        F.min_by("from", "seq").alias("from"),
        F.max_by("to", "seq").alias("to"),
        F.count("*").alias("setups"),
        F.sum(F.col("backsight") - F.col("foresight")).alias("raw"),
        F.sum(imbalance).alias("imbalance"),
        F.sum(F.col("backsight_distance") + F.col("foresight_distance")).alias("length"),
        F.sum(F.col("backsight_variance") + F.col("foresight_variance")).alias("reading_variance"),
    )
    return sums.withColumns({
        "height_difference": F.col("raw") - collimation * F.col("imbalance"),
        "variance": F.col("reading_variance") + F.col("imbalance") * F.col("imbalance") * collimation_variance,
    }).drop("raw", "reading_variance")


def discontinuities(setups: DataFrame) -> DataFrame:
    """Setups that do not start where the line's setup before ended."""
    before = F.lag("to").over(Window.partitionBy("line").orderBy("seq"))
    return setups.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("from"))).select("line", "seq", "before", "from")


def weight(weighting: str, length: Column, setups: Column) -> Column:
    return {"length": length, "count": setups}[weighting]


def line_closures(lines: DataFrame, known: DataFrame, coefficient: float, weighting: str = "length") -> DataFrame:
    """Misclosure of each line against a known difference of its ends (from, to, known, known_variance), with the permissible
    coefficient * sqrt(kilometres)."""
    joined = lines.join(known, ["from", "to"])
    return joined.select("line", (F.col("height_difference") - F.col("known")).alias("misclosure"), (F.col("variance") + F.col("known_variance")).alias("variance"), (coefficient * F.sqrt(F.col("length") / 1000.0)).alias("permissible"), weight(weighting, F.col("length"), F.col("setups")).alias("weight")).withColumn("passed", F.abs("misclosure") <= F.col("permissible"))


def loop_closures(legs: DataFrame, coefficient: float) -> DataFrame:
    """legs: loop, seq, line, sign (+1 along the line, -1 against it) with the line's columns. A loop whose legs do not
    chain and return has closes = false."""
    along = F.col("sign") > 0
    legs = legs.withColumns({"a": F.when(along, F.col("from")).otherwise(F.col("to")), "b": F.when(along, F.col("to")).otherwise(F.col("from"))})
    order = Window.partitionBy("loop").orderBy("seq")
    legs = legs.withColumn("broken", F.coalesce(F.lag("b").over(order) != F.col("a"), F.lit(False)))
    sums = legs.groupBy("loop").agg(
        F.sum(F.col("sign") * F.col("height_difference")).alias("misclosure"),
        F.sum("variance").alias("variance"),
        F.sum("length").alias("length"),
        (~F.bool_or("broken") & (F.min_by("a", "seq") == F.max_by("b", "seq"))).alias("closes"),
    )
    permissible = coefficient * F.sqrt(F.col("length") / 1000.0)
    return sums.withColumn("permissible", permissible).withColumn("passed", F.col("closes") & (F.abs("misclosure") <= F.col("permissible")))


def section_closures(lines: DataFrame, coefficient: float) -> DataFrame:
    """Every further run of a section against its first, on the shorter one's length. Runs of a section may go either way."""
    a, b = F.least("from", "to"), F.greatest("from", "to")
    runs = lines.withColumns({"a": a, "b": b, "dh": F.when(F.col("from") <= F.col("to"), F.col("height_difference")).otherwise(-F.col("height_difference"))})
    first = Window.partitionBy("a", "b").orderBy("line")
    runs = runs.withColumns({"run": F.row_number().over(first), "dh1": F.first("dh").over(first), "length1": F.first("length").over(first), "variance1": F.first("variance").over(first)})
    out = runs.where("run > 1").select("a", "b", "line", (F.col("dh") - F.col("dh1")).alias("discrepancy"), (F.col("variance") + F.col("variance1")).alias("variance"), F.least("length", "length1").alias("length"))
    permissible = coefficient * F.sqrt(F.col("length") / 1000.0)
    return out.withColumn("permissible", permissible).withColumn("passed", F.abs("discrepancy") <= F.col("permissible"))


def distribute(rows: DataFrame, group: str, misclosure: str, weight_col: str) -> DataFrame:
    """The correction of each row: its share of its group's misclosure, with the opposite sign."""
    total = F.sum(weight_col).over(Window.partitionBy(group))
    return rows.withColumn("correction", -F.col(misclosure) * F.col(weight_col) / total)


def reciprocal(crossings: DataFrame, inflation: float = 2.0, tolerance: float = 0.0) -> DataFrame:
    """Pairs of differences observed from both banks (crossing, bank 1 or 2, height_difference, variance): mean and discrepancy."""
    per_bank = lambda n, c: F.max(F.when(F.col("bank") == n, F.col(c)))
    sums = crossings.groupBy("crossing").agg(per_bank(1, "height_difference").alias("d1"), per_bank(2, "height_difference").alias("d2"), per_bank(1, "variance").alias("v1"), per_bank(2, "variance").alias("v2"))
    both = sums.where("d1 is not null and d2 is not null")
    return both.select("crossing", ((F.col("d1") + F.col("d2")) / 2.0).alias("height_difference"), (inflation * (F.col("v1") + F.col("v2")) / 4.0).alias("variance"), (F.col("d1") - F.col("d2")).alias("discrepancy")).withColumn("passed", (F.lit(tolerance) <= 0) | (F.abs("discrepancy") <= tolerance))


def orthometric_correction(latitude_from: Column, latitude_to: Column, height_from: Column, height_to: Column, beta: float = GRAVITY_FLATTENING) -> Column:
    """Normal orthometric correction of a height difference."""
    middle, height = (latitude_from + latitude_to) / 2.0, (height_from + height_to) / 2.0
    return -beta * F.sin(2.0 * middle) * height * (latitude_to - latitude_from)


def correct_lines(lines: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds the orthometric correction to lines whose ends both have latitude and height (station, latitude, height);
    the others keep a null correction."""
    start = positions.select(F.col("station").alias("from"), F.col("latitude").alias("lat_a"), F.col("height").alias("h_a"))
    end = positions.select(F.col("station").alias("to"), F.col("latitude").alias("lat_b"), F.col("height").alias("h_b"))
    joined = lines.join(start, "from", "left").join(end, "to", "left")
    correction = orthometric_correction(F.col("lat_a"), F.col("lat_b"), F.col("h_a"), F.col("h_b"))
    return joined.withColumn("correction", correction).withColumn("corrected", F.col("height_difference") + F.col("correction")).drop("lat_a", "lat_b", "h_a", "h_b")


def empirical_sigma(residual: Column) -> Column:
    """An aggregate: sqrt(sum e^2 / (1.5 n)) of three-wire half-sum residuals."""
    return F.sqrt(F.sum(residual * residual) / (1.5 * F.count(residual)))


def weighted_sigma(k: float, extent: Column | None) -> Column:
    return F.lit(k) if extent is None else k * F.sqrt(extent)


