"""Incremental day builds over stored tables, from a table of records or from a folder that files are added to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.functions import time as T
from daygrid.operators import days as D
from daygrid.operators import grid, intervals
from daygrid.plans.grid import record_parts
from daygrid.sources import files
from daygrid.sources.session import scratch_path

DAY = D.DAY


def build_days(
    spark: SparkSession,
    records: DataFrame,
    days_path: str,
    stats_path: str,
    force_recompute: bool = False,
    force_recompute_stats: bool = False,
    skip: list | None = None,
) -> None:
    """Add the days that are not stored yet, and their statistics.

    Only records of new days are gridded; a run without new days reads the records' days and the keys of what is stored
    and ends. Statistics of new days are appended to the stored ones. ``force_recompute`` rebuilds everything;
    ``force_recompute_stats`` recomputes all statistics from the stored days; participants in ``skip`` are left out. A
    run that dies is simply repeated: days already committed are skipped.
    """
    parts = record_parts(_without(records, skip))
    days = intervals.day_index(parts)
    if files.exists(spark, days_path) and not force_recompute:
        days = days.join(stored_keys(spark, days_path), DAY, "left_anti")
    days = _stored(days, "new-days")
    if force_recompute or not days.isEmpty():
        files.write_days(_built(parts, days), days_path, "overwrite" if force_recompute else "append")
    add_statistics(spark, days_path, stats_path, force_recompute or force_recompute_stats)


def build_days_from_files(
    spark: SparkSession,
    source: str,
    days_path: str,
    stats_path: str,
    ledger_path: str,
    late: str = "keep",
    skip: list | None = None,
    read: Callable[[SparkSession, list[str]], DataFrame] = files.read_records,
) -> list[str]:
    """Take in the files below ``source`` that no earlier run has; returns their paths.

    The ledger lists path, size and time of change of every file taken in; a run without new files reads it, lists the
    folder and ends, without opening a file. Else days are found in the new files alone. Days not stored yet are built
    from all files' records of them, as older files may hold some (of a day without quantity records, say); those reads
    are bounded by time, which skips files and row groups. Days that are stored stay as they are with ``late="keep"``
    (the published behaviour) and are replaced, with their statistics, with ``late="rebuild"``. A file that changes
    counts as new. The ledger is written last: a run that dies is repeated.
    """
    if late not in ("keep", "rebuild"):
        raise ValueError(f"late days are kept or rebuilt, not {late!r}")
    listed = files.listed(spark, source)
    if files.exists(spark, ledger_path):
        listed = listed.join(spark.read.parquet(ledger_path), files.FILE, "left_anti")
    # Paths of files to be read are the driver's anyway: it plans the scan with them.
    rows = listed.collect()
    if not rows:
        return []
    paths = sorted(r["path"] for r in rows)
    # Also days without quantity records in the new files: older ones may have them.
    touched = _stored(record_parts(_without(read(spark, paths), skip)).select(*DAY).distinct(), "touched-days")
    replace = None
    if files.exists(spark, days_path):
        known = stored_keys(spark, days_path)
        fresh = touched.join(known, DAY, "left_anti")
        if late == "rebuild":
            replace = _stored(touched.join(known, DAY, "left_semi"), "late-days")
            fresh = touched
    else:
        fresh = touched
    bounds = fresh.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    if bounds["lo"] is not None:
        # A record of a local day may start up to a day and an offset before it, and last a day.
        def around(day, shift):
            return (day.toordinal() - 719163 + shift) * T.DAY

        every = [r["path"] for r in files.listed(spark, source).collect()]
        near = _without(read(spark, every), skip).where(
            (F.col("start_us") >= around(bounds["lo"], -2)) & (F.col("start_us") < around(bounds["hi"], 3))
        )
        parts = record_parts(near).join(fresh, DAY, "left_semi")
        days = _stored(intervals.day_index(parts), "new-days")
        if replace is not None and not replace.isEmpty():
            files.replace_days(spark, _built(parts, days), replace, days_path)
            files.drop_keys(spark, replace, stats_path)
        elif not days.isEmpty():
            files.write_days(_built(parts, days), days_path)
    add_statistics(spark, days_path, stats_path)
    spark.createDataFrame(rows, listed.schema).coalesce(1).write.mode("append").parquet(ledger_path)
    return paths


def _without(records: DataFrame, skip: list | None) -> DataFrame:
    if not skip:
        return records
    return records.where(F.col("participant_id").isNull() | ~F.col("participant_id").isin(*skip))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _built(parts: DataFrame, days: DataFrame) -> DataFrame:
    stretches = grid.value_stretches(parts.join(days.select(*DAY), DAY, "left_semi"))
    return D.compact(stretches, days)


def add_statistics(spark: SparkSession, days_path: str, stats_path: str, force: bool = False) -> None:
    """Statistics of the stored days that have none yet, or of all; stored days hold all that they need."""
    if not files.exists(spark, days_path):
        return
    stored, mode = spark.read.parquet(days_path), "overwrite"
    if files.exists(spark, stats_path) and not force:
        stored, mode = stored.join(stored_keys(spark, stats_path), DAY, "left_anti"), "append"
        if stored.isEmpty():
            return
    per_channel = D.statistics(stored).withColumnRenamed("channel_idx", "feature_index")
    columns = ("data_coverage", "n", "sum", "sum_of_squares", "original_time_offset")
    files.write_day_stats(per_channel.select(*DAY, "feature_index", *columns), stats_path, mode)


def stored_keys(spark: SparkSession, path: str) -> DataFrame:
    """Days of a stored table."""
    return spark.read.parquet(path).select(*DAY).distinct()
