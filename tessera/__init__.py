"""Spark-native geospatial tile analytics."""
