"""Similarity observatory and corpus tools on Spark DataFrames."""
