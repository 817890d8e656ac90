"""Operators over ``live`` rows (key, value, version), each a function from DataFrames to a DataFrame."""
