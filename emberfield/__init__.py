"""emberfield: environmental-risk analytics on Spark DataFrames."""
