"""Checks: DataFrames in, findings out."""
