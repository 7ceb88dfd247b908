"""millrace: batch, iterative analytics over graphs, vectors and records, built on Spark DataFrames."""

__version__ = "0.1.0"
