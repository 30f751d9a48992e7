"""Evidence-backed metric analytics on Spark DataFrames."""
