"""Spark-native analytics for sentence-similarity datasets."""
