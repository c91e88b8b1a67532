"""Spark-native analytics for code, task, event and text data."""
