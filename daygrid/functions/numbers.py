"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    """Missing is NULL inside the engine; NaN appears only in exported arrays."""
    return F.when(~F.isnan(value), value)


def rate(value: Column, duration: Column) -> Column:
    """value / duration, NULL when the duration is zero."""
    return F.try_divide(value, duration)


def holds(condition: Column) -> Column:
    """A predicate that is false, not NULL, on missing input."""
    return F.coalesce(condition, F.lit(False))


def bin_label(value: Column, edges: list[float], names: list[str], unknown: str) -> Column:
    """Left-closed bins; values below the first edge and NULL get ``unknown``."""
    label = F.lit(unknown)
    for edge, name in zip(edges, names):
        label = F.when(value >= F.lit(edge), F.lit(name)).otherwise(label)
    return F.when(value.isNull(), F.lit(unknown)).otherwise(label)
