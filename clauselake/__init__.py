"""Clause, document and training-data analytics expressed on Spark DataFrames."""
