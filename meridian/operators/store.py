"""The project store: tables by key as Parquet, with rules of replacement, deletion and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new, and the new, one of each key. A null in a key is a value as any other."""
    once = new.dropDuplicates(keys)
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return old.alias("o").join(once.select(*keys).alias("n"), reduce(lambda a, b: a & b, same), "left_anti").select("o.*").unionByName(once)


def insert_absent(held: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """Held rows stay; offered ones with a new key are added. `outcome` says which."""
    added = offered.join(held.select(*keys), keys, "left_anti").withColumn("outcome", F.lit("added"))
    return held.withColumn("outcome", F.lit("kept")).unionByName(added)


def differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column_name, first, second) of cells that differ, and of keys that one side lacks (column_name null). Numbers are compared
    by their bits, so that NaN equals NaN and -0.0 differs from 0.0."""
    values = [c for c in first.columns if c not in keys]
    kinds = dict(first.dtypes)

    def cell(side: str, c: str):
        v = F.col(f"{side}.{c}")
        return F.hex(v.cast("double").cast("string").cast("binary")) if kinds[c] in ("double", "float") else v.cast("string")

    a, b = first.alias("a"), second.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    joined = a.withColumn("in_a", F.lit(True)).alias("a").join(b.withColumn("in_b", F.lit(True)).alias("b"), on, "full_outer")
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), cell("a", c).alias("first"), cell("b", c).alias("second")) for c in values))
    both = F.col("a.in_a") & F.col("b.in_b")
    missing = F.array(F.struct(F.lit(None).cast("string").alias("column_name"), F.col("a.in_a").cast("string").alias("first"), F.col("b.in_b").cast("string").alias("second")))
    unlike = F.filter(cells, lambda x: ~x["first"].eqNullSafe(x["second"]))
    found = joined.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), F.explode(F.when(F.coalesce(both, F.lit(False)), unlike).otherwise(missing)).alias("d"))
    return found.select(*keys, "d.*")


def delete_unreferenced(rows: DataFrame, asked: DataFrame, children: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Rows left after deleting those asked for that no child refers to; and the rows that were refused."""
    used = children.select(F.col(foreign).alias(key)).distinct()
    refused = asked.join(used, key, "left_semi")
    gone = asked.join(used, key, "left_anti").select(key)
    return rows.join(gone, key, "left_anti"), refused


def supersede(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Sets superseded_by from pairs (old, new); both must exist and differ, else the pair has no effect."""
    known = rows.select(F.col(key).alias("new"))
    valid = pairs.where("old <> new").join(known, "new", "left_semi").select(F.col("old").alias(key), "new")
    return rows.join(valid, key, "left").withColumn("superseded_by", F.coalesce("new", "superseded_by")).drop("new")


def row_runs(rows: DataFrame, number: str, block: int = 1 << 16) -> DataFrame:
    """Runs of consecutive row numbers: (first_row, last_row). Islands are found within blocks of numbers, and islands that meet at a
    block's edge are joined by an equi-join on that edge, so that no window spans all rows."""
    b = F.floor(F.col(number) / block)
    w = Window.partitionBy("block").orderBy(number)
    inside = rows.select(number).distinct().withColumn("block", b)
    inside = inside.withColumn("island", F.col(number) - F.row_number().over(w)).groupBy("block", "island").agg(F.min(number).alias("first_row"), F.max(number).alias("last_row"))
    starts = inside.select((F.col("first_row") - 1).alias("edge"), F.lit(True).alias("goes_on"))
    ends = inside.select((F.col("last_row") + 1).alias("first_row"), F.lit(True).alias("continues"))
    flagged = inside.join(starts, F.col("last_row") == F.col("edge"), "left").join(ends, "first_row", "left")
    # most runs lie inside a block; only the islands at the edges of blocks, two a block at most, are ordered to be paired
    whole = flagged.where("continues is null and goes_on is null").select("first_row", "last_row")
    heads = flagged.where("continues is null and goes_on").select(F.col("first_row").alias("at"), F.lit(0).alias("kind"))
    tails = flagged.where("continues and goes_on is null").select(F.col("last_row").alias("at"), F.lit(1).alias("kind"))
    order = Window.orderBy("at", "kind")
    paired = heads.unionByName(tails).withColumn("first_row", F.lag("at").over(order)).where("kind = 1")
    return whole.unionByName(paired.select("first_row", F.col("at").alias("last_row")))


#: Sheets of a result export and their columns.
SHEETS = {
    "stations": ("network_id", "station", "x", "y", "z"),
    "residuals": ("network_id", "obs", "residual", "redundancy"),
    "statistics": ("network_id", "rows", "unknowns", "dof", "vpv", "variance_factor"),
}


def export_sheets(results: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV folder a sheet that has rows: full precision, booleans as 1 and 0, null as empty."""
    written = []
    for name, columns in SHEETS.items():
        if name not in results or results[name].isEmpty():
            continue
        rows = results[name].select(*columns)
        text = [F.col(c).cast("int").cast("string").alias(c) if t == "boolean" else F.col(c).cast("string").alias(c) for c, t in rows.dtypes]
        rows.select(*text).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/{name}")
        written.append(name)
    return written
