"""Clinical encounter analytics on Spark DataFrames."""
