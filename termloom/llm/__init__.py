"""Operators for large-scale training-data preparation, each a function of DataFrames."""
