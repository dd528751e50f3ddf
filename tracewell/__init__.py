"""Spark-native analytics over code findings, call graphs and taint facts."""

__version__ = "0.1.0"
