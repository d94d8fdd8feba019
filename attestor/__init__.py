"""Spark-native analytics over evidence-grounded document and API-contract data."""

__version__ = "0.1.0"
