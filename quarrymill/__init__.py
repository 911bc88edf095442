"""Spark-native automated machine learning and tabular analytics."""

__version__ = "0.1.0"
