"""Operators: each takes DataFrames and gives a DataFrame (or a pair of them)."""
