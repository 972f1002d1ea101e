"""Spark-native reconciliation of document-derived facts."""

__version__ = "0.1.0"
