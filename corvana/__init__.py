"""Spark-native engine for text, timeline, vector and signal analytics."""
