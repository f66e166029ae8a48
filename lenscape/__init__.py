"""Spark-native analytics for media catalogs."""
