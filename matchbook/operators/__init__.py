"""Reusable operators: DataFrames in, DataFrames out."""
