"""Record-log analytics on Spark DataFrames."""
