"""Spark-native operators for airline-operations analytics."""
