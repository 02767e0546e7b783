"""Operators: DataFrames in, DataFrame out, no driver-side loops over rows."""
