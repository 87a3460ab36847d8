"""spanloom: token-sequence analytics on Spark DataFrames."""
