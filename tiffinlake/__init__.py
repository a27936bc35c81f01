"""Spark-native analytics for streams of order events."""

__version__ = "0.1.0"
