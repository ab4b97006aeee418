"""Essay analytics on Spark DataFrames."""
