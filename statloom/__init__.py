"""Statistics jobs on Spark DataFrames."""
