"""Records to day grids and day statistics, all participants in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from daygrid.operators import clean, grid, intervals, stats


def record_parts(records: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """Units, filters, local time, midnight split, date and channel. No shuffle.

    Filters run on recorded times, before the shift.
    """
    df = clean.without_modalities(records, skip or [])
    df = clean.normalise_units(df)
    df = clean.keep_plausible(df)
    df = clean.to_local_time(df)
    df = intervals.split_union_at_midnight(df)
    return intervals.with_channel(intervals.with_local_date(df))


def day_grid(records: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """Dense storage rows for every output day."""
    parts = record_parts(records, skip)
    days = intervals.day_index(parts, skip_quantity="healthkit" in (skip or []))
    return grid.day_channel(grid.value_stretches(parts), days)


def day_statistics(records: DataFrame, skip: list[str] | None = None) -> DataFrame:
    parts = record_parts(records, skip)
    days = intervals.day_index(parts, skip_quantity="healthkit" in (skip or []))
    return stats.day_stats(grid.minute_values(parts), days)


def observed_minutes(records: DataFrame) -> DataFrame:
    """Sparse minutes of existing days."""
    parts = record_parts(records)
    return grid.minute_values(parts, intervals.output_days(parts))
