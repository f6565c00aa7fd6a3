"""A Spark-native engine for ingesting, searching and evaluating document collections."""

__version__ = "0.1.0"
