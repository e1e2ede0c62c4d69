"""survspark: survival analytics on Spark DataFrames."""
