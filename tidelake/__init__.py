"""Spark-native analytics for market surveillance data."""
