"""Volumetric and point-set analytics on Spark DataFrames."""
