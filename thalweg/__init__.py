"""Spark-native geomorphology analytics: grids, profiles, channels, basins and map units as DataFrames."""
