"""Spark-native analytics for document evidence."""

__version__ = "0.1.0"
