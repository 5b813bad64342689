"""Operators for preparing text corpora at large scale, built on Spark DataFrames."""
