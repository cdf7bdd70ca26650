"""Spark-native interferometric imaging and analytics."""
