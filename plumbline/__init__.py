"""Spark-native analytics for map artifacts: vector tiles and style documents as DataFrames."""
