"""Stored stages: each job of the chain reads the table the previous one wrote.

records -> stretches of minutes, day statistics, days as runs -> windows -> labelled windows. A stage is written once per
application and input folder, under the shared scratch folder, and read back by every later job. That cuts
the lineage with a table that survives the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.operators import days, grid, intervals, labels, stats, windows
from daygrid.plans.grid import record_parts
from daygrid.sources import adapter, files
from daygrid.sources.session import stored_stage

# Thresholds fitting the driver's tables, where a participant has about two records a day.
MIN_COVERAGE = 0.1
MIN_CHANNELS = 1

def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_parts(adapter.records(spark, sf_dir))


def local_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned records in local time, not yet split, with their local date."""
    from daygrid.operators import clean

    df = clean.to_local_time(clean.keep_plausible(clean.normalise_units(adapter.records(spark, sf_dir))))
    return intervals.with_local_date(clean.sleep_end_from_duration(df))


def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        p = parts(spark, sf_dir)
        return grid.value_stretches(p, intervals.output_days(p))

    return stored_stage(spark, sf_dir, "stretches", build)


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per minute, listed where it is read; stretches are what is stored."""
    return grid.every_minute(stretches(spark, sf_dir))


def day_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_stage(spark, sf_dir, "day_index", lambda: intervals.day_index(parts(spark, sf_dir)))


def day_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_stage(
        spark,
        sf_dir,
        "day_stats",
        lambda: stats.day_stats(minutes(spark, sf_dir), day_index(spark, sf_dir)),
    )


def day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as runs; dense rows are made of them where they are used."""
    return stored_stage(
        spark,
        sf_dir,
        "day_runs",
        lambda: days.compact(stretches(spark, sf_dir), day_index(spark, sf_dir)),
    )


def day_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days.expand(day_runs(spark, sf_dir))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.day_quality(day_stats(spark, sf_dir), MIN_COVERAGE, MIN_CHANNELS)


def window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_stage(spark, sf_dir, "windows", lambda: windows.windows(quality(spark, sf_dir)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_stage(
        spark,
        sf_dir,
        "labelled",
        lambda: labels.labelled_windows(
            window_table(spark, sf_dir), adapter.label_table(spark, sf_dir)
        ),
    )


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.flatten_labels(labelled(spark, sf_dir))


def day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.day_summary(day_stats(spark, sf_dir))


def standardization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.standardization(day_stats(spark, sf_dir))
