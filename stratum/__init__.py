"""Sharded, temporally versioned tables on Spark DataFrames."""
