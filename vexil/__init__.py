"""Vector retrieval, hybrid softmax and evaluation analytics on Spark DataFrames."""
