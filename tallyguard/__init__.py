"""Spark-native analytics for document and claim fraud detection."""

__version__ = "0.1.0"
