"""Loomspan: event-sequence analytics and corpus preparation on Spark DataFrames."""
