"""Spark-native label clustering and record matching."""
