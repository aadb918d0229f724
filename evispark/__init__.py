"""Spark-native evidence and provenance analytics."""
