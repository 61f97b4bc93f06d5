"""Code, log and change analytics on Spark DataFrames."""
