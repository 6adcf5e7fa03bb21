"""Vector, sparse and hybrid retrieval analytics on PySpark DataFrames."""
