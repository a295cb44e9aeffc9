"""Interval records to per-minute day grids, as PySpark DataFrame transformations."""
