"""Auricle: Spark-native analytics over media-library metadata."""
