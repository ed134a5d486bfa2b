"""Spark-native full-text search and corpus analytics."""

__version__ = "0.1.0"
