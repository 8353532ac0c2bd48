"""A graph-ranking engine on Spark DataFrames."""
