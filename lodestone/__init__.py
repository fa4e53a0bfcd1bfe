"""Spark-native matching, routing and sequence selection over precomputed vectors, boxes and metrics."""
