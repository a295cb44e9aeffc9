"""Selection of day windows per participant.

Each participant is reduced to the set of its distinct days (at most one entry per calendar day) before
anything else, and the greedy selection is one fold over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import arrays as A


def day_quality(
    stats: DataFrame,
    min_channel_coverage: float | None = C.MIN_CHANNEL_COVERAGE,
    min_channels_with_data: int | None = C.MIN_CHANNELS_WITH_DATA,
) -> DataFrame:
    """One row per participant-day with ``valid``. Either criterion may be switched off with None."""
    days = stats.groupBy("participant_id", "date").agg(
        F.sum("data_coverage").alias("total_coverage"),
        F.count_if(F.col("data_coverage") > 0).alias("channels_with_data"),
    )
    valid = F.lit(True)
    if min_channel_coverage is not None:
        valid = valid & (F.col("total_coverage") >= F.lit(min_channel_coverage))
    if min_channels_with_data is not None:
        valid = valid & (F.col("channels_with_data") >= F.lit(min_channels_with_data))
    return days.withColumn("valid", valid)


def participant_days(quality: DataFrame) -> DataFrame:
    """Sorted existing and valid days (as day numbers) per participant."""
    number = F.unix_date("date")
    return quality.groupBy("participant_id").agg(
        F.array_sort(F.collect_set(number)).alias("days"),
        F.array_sort(F.collect_set(F.when(F.col("valid"), number))).alias("valid_days"),
    )


def as_dates(days: Column) -> Column:
    return F.transform(days, lambda d: F.date_from_unix_date(d))


def _earliest_start(days: Column, i: Column, size: int, required: int) -> Column:
    """Earliest start in (days[i-1], days[i]] whose window holds ``required`` days counted from days[i]."""
    after_previous = F.when(i > 0, F.get(days, i - 1) + 1).otherwise(F.get(days, F.lit(0)))
    return F.greatest(after_previous, F.get(days, i + required - 1) - size + 1)


def greedy_windows(
    days: Column, size: int = C.WINDOW_DAYS, required: int = C.MIN_REQUIRED_DAYS
) -> Column:
    """Starts of non-overlapping windows over a sorted array of distinct day numbers.

    The candidate start moves day by day from the first day; a window with enough days is taken and the
    next candidate is the day after it. Instead of trying every calendar day, the fold visits each day
    once: for day i it computes the earliest start that makes i the first day inside and reaches
    ``required`` days. Linear in the number of days.
    """


    def select(days):
        n = F.size(days)
        last_start = F.get(days, n - 1) - (size - 1)
        if required <= 0:
            first = F.get(days, F.lit(0))
            starts = F.when(last_start >= first, F.sequence(first, last_start, F.lit(size)))
            return F.coalesce(starts, F.array().cast("array<int>"))
        state = F.struct(
            F.lit(-(2**31) + 1).alias("free_from"), F.array().cast("array<int>").alias("starts")
        )

        def step(acc, i):
            start = F.greatest(acc["free_from"], _earliest_start(days, i, size, required))
            take = (start <= F.get(days, i)) & (start <= last_start)
            return F.struct(
                F.when(take, start + size).otherwise(acc["free_from"]).alias("free_from"),
                F.when(take, F.concat(acc["starts"], F.array(start)))
                .otherwise(acc["starts"])
                .alias("starts"),
            )

        return F.aggregate(A.positions(n - (required - 1)), state, step, lambda acc: acc["starts"])

    return A.let(days, select)


def has_window(days: Column, size: int, max_missing: int) -> Column:
    """Whether some run of ``size`` days inside the span misses at most ``max_missing`` of them."""
    required = size - max_missing

    def test(days):
        n = F.size(days)
        last_start = F.get(days, n - 1) - (size - 1)
        if required <= 0:
            return F.coalesce(last_start >= F.get(days, F.lit(0)), F.lit(False))
        return F.exists(
            A.positions(n - (required - 1)),
            lambda i: _earliest_start(days, i, size, required)
            <= F.least(F.get(days, i), last_start),
        )

    return A.let(days, test)


def windows(
    quality: DataFrame, size: int = C.WINDOW_DAYS, required: int = C.MIN_REQUIRED_DAYS
) -> DataFrame:
    """All windows of all participants with the existing days inside each: one shuffle on participant."""
    starts = greedy_windows(F.col("valid_days"), size, required)
    out = participant_days(quality).select(
        "participant_id", "days", F.explode(starts).alias("_start")
    )
    end = F.col("_start") + (size - 1)
    return out.select(
        "participant_id",
        F.date_from_unix_date("_start").alias("start_date"),
        F.date_from_unix_date(end).alias("end_date"),
        as_dates(F.filter("days", lambda d: (d >= F.col("_start")) & (d <= end))).alias("days"),
    )


def time_range(start: str = "start_date", end: str = "end_date") -> Column:
    return F.concat_ws(
        "_", F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")
    )


def qualifying_participants(quality: DataFrame) -> DataFrame:
    """Window flags per participant, over all existing days."""
    days = participant_days(quality)
    return days.select(
        "participant_id",
        *[
            has_window(F.col("days"), size, missing).alias(f"has_{name}_window")
            for name, (size, missing) in C.QUALIFYING_WINDOWS.items()
        ],
    )


def qualifying_report(flags: DataFrame) -> DataFrame:
    """Number and percentage of participants passing each window rule."""
    names = [f"has_{n}_window" for n in C.QUALIFYING_WINDOWS]
    one = flags.agg(
        F.count("*").alias("participants"), *[F.count_if(F.col(n)).alias(n) for n in names]
    )
    return one.unpivot(["participants"], names, "rule", "n").select(
        "rule", "n", "participants", (F.col("n") * 100.0 / F.col("participants")).alias("percent")
    )
