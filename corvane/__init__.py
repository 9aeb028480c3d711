"""Corvane: corpus-conditioned signal evaluation on Spark DataFrames."""
