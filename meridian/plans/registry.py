"""The registry of queries, and the survey-shaped views of the relational tables that both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query with its SQL. Views named in `sql` as {view} become their SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.format(**{k: f"({v})" for k, v in VIEWS.items()})
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its times, which carry no zone, are UTC."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def r(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison; a zero has no sign."""
    return F.round(value, digits) + F.lit(0.0)


#: The same views for SQL. Sessions are users, stations are event types, and so on.
VIEWS = {
    "readings": "SELECT user_id AS session, event_type AS station, ts AS instant, event_id, value, 1.0 / (1 + event_id % 5) AS variance FROM events",
    "setups": "SELECT l_orderkey AS line, l_linenumber AS seq, 'S' || max(l_suppkey % 7) AS \"from\", 'S' || max(l_partkey % 7) AS \"to\", max(l_quantity) / 25.0 AS backsight, max(l_discount) * 10.0 AS foresight, 20.0 + 100.0 * max(l_tax) AS backsight_distance, 15.0 + 100.0 * max(l_discount) AS foresight_distance, 1e-6 AS backsight_variance, 4e-6 AS foresight_variance FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "points": "SELECT c_custkey AS point, (c_custkey % 1601 - 800) / 1000.0 AS latitude, (c_custkey * 7 % 6001 - 3000) / 1000.0 AS longitude, c_acctbal / 10.0 AS height FROM customer",
    "edges": "SELECT 'n1' AS network_id, s_nationkey AS a, c_nationkey AS b, count(*) AS n, avg(c_acctbal) - avg(s_acctbal) AS difference FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey",
    "epochs": "SELECT 'N' || n_nationkey AS station, year(o_orderdate) + 0.5 AS epoch, avg(o_totalprice) / 1e5 AS x, avg(o_orderkey % 97) / 10.0 AS y, avg(o_custkey % 89) / 10.0 AS z, 1.0 / count(*) AS vx, 2.0 / count(*) AS vy, 3.0 / count(*) AS vz, 20 AS dof, 1.5 AS factor FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, year(o_orderdate)",
}


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("station"), F.col("ts").alias("instant"), "event_id", "value", (1.0 / (1 + F.col("event_id") % 5)).alias("variance"))


def setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("seq"))
    name = lambda c: F.concat(F.lit("S"), F.max(F.col(c) % 7).cast("string"))
    return rows.agg(
        name("l_suppkey").alias("from"),
        name("l_partkey").alias("to"),
        (F.max("l_quantity") / 25.0).alias("backsight"),
        (F.max("l_discount") * 10.0).alias("foresight"),
        (20.0 + 100.0 * F.max("l_tax")).alias("backsight_distance"),
        (15.0 + 100.0 * F.max("l_discount")).alias("foresight_distance"),
        F.lit(1e-6).alias("backsight_variance"),
        F.lit(4e-6).alias("foresight_variance"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("point"), ((c % 1601 - 800) / 1000.0).alias("latitude"), ((c * 7 % 6001 - 3000) / 1000.0).alias("longitude"), (F.col("c_acctbal") / 10.0).alias("height"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    joined = joined.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("s_nationkey <> c_nationkey")
    return joined.groupBy(F.lit("n1").alias("network_id"), F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.count("*").alias("n"), (F.avg("c_acctbal") - F.avg("s_acctbal")).alias("difference"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    grouped = o.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("station"), (F.year("o_orderdate") + F.lit(0.5)).cast("double").alias("epoch"))
    n = F.count("*")
    return grouped.agg(
        (F.avg("o_totalprice") / 1e5).alias("x"),
        (F.avg(F.col("o_orderkey") % 97) / 10.0).alias("y"),
        (F.avg(F.col("o_custkey") % 89) / 10.0).alias("z"),
        (1.0 / n).alias("vx"),
        (2.0 / n).alias("vy"),
        (3.0 / n).alias("vz"),
        F.lit(20).alias("dof"),
        F.lit(1.5).alias("factor"),
    )
