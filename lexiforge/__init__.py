"""Spark-native transcript correction and term knowledge."""
