"""seqloom: sequence-family analytics on Spark DataFrames."""
