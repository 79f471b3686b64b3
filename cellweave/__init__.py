"""cellweave: gridded-hazard analytics on Spark DataFrames."""
