"""The questions users ask, each a function from DataFrames to a DataFrame."""
