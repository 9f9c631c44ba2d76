"""Spark-native analytics for text pairs and entity graphs."""

__all__ = ["session"]
