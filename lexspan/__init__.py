"""lexspan: citation extraction, resolution and corpus analytics on Spark DataFrames."""
