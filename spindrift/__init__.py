"""Spark-native privacy, profiling and data-quality engine."""
