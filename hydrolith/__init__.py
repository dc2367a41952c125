"""Spark-native analytics for weather-radar grids, catalogues and text corpora."""
