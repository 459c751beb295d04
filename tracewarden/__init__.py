"""Lineage-governance analytics on Spark DataFrames."""
