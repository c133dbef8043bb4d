"""Evidence and log analytics on Spark DataFrames."""
