"""Spark-native analytics for market bars and for statement checks."""
