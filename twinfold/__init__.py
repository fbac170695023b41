"""Spark-native engine for finding, scoring, grouping and ranking duplicated content."""

__version__ = "0.1.0"
