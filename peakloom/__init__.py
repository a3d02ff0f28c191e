"""Consensus-region analytics for multi-sample signal, on Spark DataFrames."""
