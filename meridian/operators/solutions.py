"""Solutions: what can be compared, comparisons, breakdowns, ellipses of pairs, and rows for tables and maps.

stations: network_id, station, x, y, z; residuals: network_id, obs, residual, weight, redundancy, weighted; cofactors:
network_id, i, j, q, with unknowns named station:x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.adjustment import ellipse
from meridian.operators.monitoring import COMPARED, nice_factor, require_comparable



def constrained_stations(stations: DataFrame) -> DataFrame:
    return stations.where(F.coalesce(F.col("fixed"), F.lit(False)))


def matches(rows: DataFrame, decision: str | None, text: str = "") -> DataFrame:
    """Rows of one decision (any, if none is given) whose name has the text in it, in upper or lower case."""
    kind = F.lit(True) if decision is None else F.col("decision") == decision
    return rows.where(kind & F.contains(F.lower("obs"), F.lit(text.lower())))


def observation_rows(snooped: DataFrame, observations: DataFrame) -> DataFrame:
    own = observations.select("network_id", "obs", "type", "value", F.sqrt("variance").alias("sigma"))
    return snooped.join(own, ["network_id", "obs"]).select("network_id", "obs", "type", "value", "sigma", "residual", "redundancy", "w", "decision")


def station_rows(stations: DataFrame, cofactors: DataFrame, variance_factor: Column | None = None) -> DataFrame:
    """Coordinates with their sigmas; null where a component was not estimated."""
    factor = F.lit(1.0) if variance_factor is None else variance_factor
    d = cofactors.where("i = j").select("network_id", F.expr("substring_index(i, ':', 1)").alias("station"), F.expr("substring_index(i, ':', -1)").alias("c"), F.sqrt(F.col("q") * factor).alias("s"))
    sigma = d.groupBy("network_id", "station").agg(*(F.max(F.when(F.col("c") == c, F.col("s"))).alias(f"sigma_{c}") for c in "xyz"))
    return stations.join(sigma, ["network_id", "station"], "left")


def statistics_items(statistics: DataFrame) -> DataFrame:
    """(network_id, item, value) of each statistic."""
    names = [c for c, t in statistics.dtypes if c != "network_id" and t in ("int", "bigint", "double")]
    return statistics.select("network_id", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["network_id"], names, "item", "value")


def run_summary(statistics: DataFrame, snooped: DataFrame) -> DataFrame:
    """A row a network: its statistics and how many observations were rejected or can't be checked."""
    count = lambda d: F.count_if(F.col("decision") == d)
    own = snooped.groupBy("network_id").agg(count("rejected").alias("rejected"), count("uncheckable").alias("uncheckable"), F.max("w").alias("largest_w"))
    return statistics.join(own, "network_id", "left")


def incomparable(first: DataFrame, second: DataFrame, key: str = "solution", fields: tuple[str, ...] = COMPARED) -> DataFrame:
    """(first, second, reasons): for each pair of solutions, the fields in which both state something else."""
    own = [f for f in fields if f in first.columns and f in second.columns]
    a, b = first.alias("a"), second.alias("b")
    reasons = F.filter(F.array(*(F.when(F.col(f"a.{f}") != F.col(f"b.{f}"), F.lit(f)) for f in own)), lambda x: x.isNotNull())
    return a.join(b, F.col(f"a.{key}") < F.col(f"b.{key}")).select(F.col(f"a.{key}").alias("first"), F.col(f"b.{key}").alias("second"), reasons.alias("reasons"))


def compare_solutions(reference: DataFrame, other: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """All rows of both by key: differences, whether each is within its tolerance, and which side a row without partner is of."""
    a, b = reference.select(*keys, *tolerances, F.lit(True).alias("_a")), other.select(*keys, *(F.col(c).alias(f"{c}_other") for c in tolerances), F.lit(True).alias("_b"))
    joined = a.join(b, keys, "full")
    side = F.when(F.col("_b").isNull(), "reference").when(F.col("_a").isNull(), "other")
    for c, limit in tolerances.items():
        joined = joined.withColumn(f"d_{c}", F.col(f"{c}_other") - F.col(c)).withColumn(f"agrees_{c}", F.abs(F.col(f"{c}_other") - F.col(c)) <= limit)
    return joined.withColumn("only_in", side).drop("_a", "_b")


def technique_breakdown(residuals: DataFrame, observations: DataFrame) -> DataFrame:
    """Per technique: rows, redundancy and its share, v'Pv, variance factor, largest standardised residual, uncheckable rows."""
    own = residuals.join(observations.select("network_id", "obs", "technique"), ["network_id", "obs"])
    w = F.when(F.col("redundancy") >= 0.01, F.abs("residual") * F.sqrt(F.col("weight") / F.col("redundancy")))
    sums = own.groupBy("network_id", "technique").agg(F.count("*").alias("rows"), F.sum("redundancy").alias("redundancy"), F.sum(F.col("residual") * F.col("weighted")).alias("vpv"), F.max(w).alias("largest_w"), F.count_if(F.col("redundancy") < 0.01).alias("uncheckable"))
    total = F.sum("redundancy").over(Window.partitionBy("network_id"))
    return sums.withColumn("share", F.col("redundancy") / total).withColumn("variance_factor", F.when(F.col("redundancy") > 0, F.col("vpv") / F.col("redundancy")))


def relative_ellipses(cofactors: DataFrame, pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    """(network_id, a, b, semi_major, semi_minor, azimuth) of the vectors between pairs (network_id, a, b): S_aa + S_bb - S_ab - S_ba.
    Entries that are not there count as zero, as those of a held station are."""
    e = cofactors.select("network_id", F.expr("substring_index(i, ':', 1)").alias("s"), F.expr("substring_index(i, ':', -1)").alias("c"), F.expr("substring_index(j, ':', 1)").alias("t"), F.expr("substring_index(j, ':', -1)").alias("d"), "q")
    e = e.where("c in ('x', 'y') and d in ('x', 'y')")
    ends = pairs.select("network_id", "a", "b", F.explode(F.array(*(F.struct(F.col(s).alias("s"), F.col(t).alias("t"), F.lit(k).alias("k")) for s, t, k in (("a", "a", 1.0), ("b", "b", 1.0), ("a", "b", -1.0), ("b", "a", -1.0))))).alias("p")).select("network_id", "a", "b", "p.*")
    pick = lambda c, d: F.coalesce(F.sum(F.when((F.col("c") == c) & (F.col("d") == d), F.col("k") * F.col("q"))), F.lit(0.0))
    c = ends.join(e, ["network_id", "s", "t"], "left").groupBy("network_id", "a", "b").agg(pick("x", "x").alias("xx"), pick("x", "y").alias("xy"), pick("y", "y").alias("yy"))
    return c.select("network_id", "a", "b", *(v.alias(k) for k, v in ellipse(F.col("xx"), F.col("xy"), F.col("yy"), scale).items()))


def positional_uncertainty(ellipses: DataFrame) -> DataFrame:
    """The radius that the semi-major axis of a confidence ellipse gives."""
    return ellipses.withColumn("positional_uncertainty", F.col("semi_major"))


def displacement_arrow(x: Column, y: Column, dx: Column, dy: Column, exaggeration: float) -> Column:
    """Both ends of an exaggerated displacement."""
    return F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + dx * exaggeration).alias("x"), (y + dy * exaggeration).alias("y")))


def default_exaggeration(rows: DataFrame, by: list[str], size: str, share: float = 0.05) -> DataFrame:
    """(keys.., exaggeration): what makes the largest size span that share of the shorter side of the extent of x and y, rounded
    down to 1, 2 or 5 times a power of ten; never under 1."""
    s = rows.groupBy(*by).agg(F.least(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.max(F.abs(F.col(size))).alias("top"))
    raw = share * F.col("side") / (2.0 * F.col("top"))
    return s.select(*by, F.when((F.col("top") > 0) & (raw > 1), nice_factor(raw)).otherwise(1.0).alias("exaggeration"))


def residual_features(residuals: DataFrame, observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Lines of observations between two stations, with their residuals."""
    own = residuals.join(observations.where(F.col("to").isNotNull()).select("network_id", "obs", "at", "to"), ["network_id", "obs"])
    end = lambda role, p: stations.select("network_id", F.col("station").alias(role), *(F.col(c).alias(f"{p}{c}") for c in "xy"))
    return own.join(end("at", "from_"), ["network_id", "at"]).join(end("to", "to_"), ["network_id", "to"]).select("network_id", "obs", "at", "to", "from_x", "from_y", "to_x", "to_y", "residual", "redundancy")


def trajectory_features(epochs: DataFrame) -> DataFrame:
    """A point an epoch, in order, with the step from the one before."""
    w = Window.partitionBy("session").orderBy("instant")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    return epochs.withColumn("place", F.row_number().over(w)).withColumn("step", step)


def series_curves(series: DataFrame, component: str, band: float = 1.96) -> DataFrame:
    """(station, epoch, value, low, high): a component's curve with its band; series have o<c> and q<c> columns."""
    half = band * F.sqrt(f"q{component}")
    return series.select("station", "epoch", F.col(f"o{component}").alias("value"), (F.col(f"o{component}") - half).alias("low"), (F.col(f"o{component}") + half).alias("high"))


def series_limits(curves: DataFrame) -> DataFrame:
    return curves.groupBy("station").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("epoch").alias("first"), F.max("epoch").alias("last"))


def solutions_using(solutions: DataFrame, observations: DataFrame) -> DataFrame:
    """Solutions (solution, observations array) that any of the observations (obs) entered, with those."""
    flat = solutions.select("solution", F.explode("observations").alias("obs"))
    return flat.join(observations.select("obs").distinct(), "obs").groupBy("solution").agg(F.sort_array(F.collect_set("obs")).alias("observations"))


def delete_solution(solutions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Solutions without the chosen ones (solution); others that one of them superseded stand again."""
    gone = chosen.select("solution").distinct()
    kept = solutions.join(gone, "solution", "left_anti")
    back = kept.join(gone.withColumnRenamed("solution", "superseded_by").withColumn("_gone", F.lit(True)), "superseded_by", "left")
    return back.withColumn("superseded_by", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("superseded_by"))).select(solutions.columns)
