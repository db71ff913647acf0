"""Density clustering of two-dimensional points as Spark DataFrames."""
