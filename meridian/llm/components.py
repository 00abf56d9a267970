"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every linked node, label being the smallest node of its component. Each round hangs every
    node below the smallest of its neighbours until all hang below the smallest of their component; the
    number of rounds grows with the logarithm of a component's diameter. Links and labels stay distributed."""
    stars = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = _state(stars)
    while True:
        # every node and its larger neighbours go below the smallest neighbour
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # every node and its smaller neighbours go below the smallest of those
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        stars = stored(small.distinct())
        before, state = state, _state(stars)
        if state == before:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _state(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
