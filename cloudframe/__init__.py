"""cloudframe: multi-view depth and point-cloud analytics on Spark DataFrames."""
