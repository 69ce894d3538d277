"""Operators on DataFrames, grouped by what they do."""
