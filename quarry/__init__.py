"""Document retrieval, evaluation and learning analytics on Spark DataFrames."""
