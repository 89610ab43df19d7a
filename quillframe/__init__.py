"""Spark-native analytics for tag/loop text data and for large text corpora."""
