"""Interaction-graph analytics on Spark DataFrames."""
