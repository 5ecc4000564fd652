"""Spark-native analytics over time-aligned bilingual text corpora."""

__version__ = "0.1.0"
