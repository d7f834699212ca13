"""Tidemark: a Spark-native engine for time-series metrics."""
