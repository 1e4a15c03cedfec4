"""Chromatography analytics on Spark DataFrames."""
