"""Operators over DataFrames of points, cells, edges and labels."""
