"""Corpus operators for training data: each module holds one method and works on Spark DataFrames."""
