"""Argument-graph analytics on Spark DataFrames."""
