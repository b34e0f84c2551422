"""Spark-native analytics over public-record style data."""
