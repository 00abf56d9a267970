"""Alerts on a stream of displacements: an extension for monitoring that goes on while it is observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_alerts(stream: DataFrame, limit: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, station, readings, largest) of windows in which a station's magnitude crossed the limit. Rows later than `late`
    are dropped by the watermark; state is one row a station and open window."""
    counted = stream.withWatermark("instant", late).groupBy(F.window("instant", window), "station").agg(F.count("*").alias("readings"), F.max("magnitude").alias("largest"))
    return counted.where(F.col("largest") > limit).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "station", "readings", "largest")


def station_state(stream: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Occupations as session windows: a station's readings with gaps below `gap`."""
    return stream.withWatermark("instant", late).groupBy(F.session_window("instant", gap), "station").agg(F.count("*").alias("readings"), F.avg("magnitude").alias("mean")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "station", "readings", "mean")
