"""Spark-native analytics for price, stock and catalogue data."""
