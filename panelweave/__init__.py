"""Longitudinal-panel analytics on Spark DataFrames."""
