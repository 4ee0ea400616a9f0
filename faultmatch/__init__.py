"""faultmatch: error-resolution analytics on Spark DataFrames."""
