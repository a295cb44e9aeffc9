"""Operators: each takes DataFrames (or Columns) and returns DataFrames (or Columns)."""
