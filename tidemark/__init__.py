"""tidemark: keyed, log-structured analytics on Spark DataFrames."""
