"""Entity-event analytics on Spark DataFrames."""
