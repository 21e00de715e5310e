"""Distributed evaluation analytics for retrieval-augmented answers, on Spark DataFrames."""

__version__ = "0.1.0"
