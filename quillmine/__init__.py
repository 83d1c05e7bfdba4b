"""Spark-native corpus building, retrieval and record analysis."""
