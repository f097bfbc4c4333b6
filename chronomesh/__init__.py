"""Travel-time analytics on Spark DataFrames."""
