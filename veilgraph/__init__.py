"""veilgraph: private graph analytics on Spark DataFrames."""
