"""Spark-native media catalog analytics."""
