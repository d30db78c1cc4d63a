"""Spark-native analysis of incident logs."""
