"""Account-statement analytics on Spark DataFrames."""
