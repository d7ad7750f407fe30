"""Spark-native hybrid retrieval and text-processing engine."""

__version__ = "0.1.0"
