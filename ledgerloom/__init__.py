"""Spark-native analysis and reconciliation engine."""
