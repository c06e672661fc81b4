"""Siftwell: a PySpark-native engine for feed records, their logs and their texts."""

__version__ = "0.1.0"
