"""quern: sequence-aware analytics on Spark DataFrames."""
