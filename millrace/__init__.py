"""Spark-native analytics over positioned text, and the tables derived from it."""
