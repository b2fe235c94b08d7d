"""Spark-native analytics for tracked measurements, geometry and their corpora."""
