"""Spark-native selective migration, provenance and analytics engine."""

__version__ = "0.1.0"
