"""seqfold: change-log analytics on Spark DataFrames."""
