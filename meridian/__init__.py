"""Meridian: a Spark-native analytics engine for survey and geodetic observations."""
