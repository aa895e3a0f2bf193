"""Spark-native analytics over city-scale grids, buildings, scenes and exposure tables."""
