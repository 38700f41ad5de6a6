"""Request-level event analytics on Spark DataFrames."""
