"""Kestrel: top-k similarity and text search on Spark DataFrames."""
