"""Versioned N-d array analytics on Spark DataFrames."""
