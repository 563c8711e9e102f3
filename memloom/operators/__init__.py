"""Relational operators: DataFrames in, DataFrames out, no collect."""
