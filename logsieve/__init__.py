"""Spark-native web access-log analytics."""

__version__ = "0.2.0"
