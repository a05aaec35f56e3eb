"""Network-metadata analytics on Spark DataFrames."""
