"""Coverage and standardization statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import arrays as A
from daygrid.functions.quantiles import exact_quantiles, summaries
from daygrid.operators.grid import KEY


def channel_statistics(minutes: DataFrame) -> DataFrame:
    """Observed minutes, sum and sum of squares per participant, day and channel."""
    seen = minutes.where(A.observed(F.col("value")))
    return seen.groupBy(*KEY).agg(
        F.count("*").cast("double").alias("n"),
        F.sum("value").alias("sum"),
        F.sum(F.col("value") * F.col("value")).alias("sum_of_squares"),
    )


def coverage(minutes: DataFrame) -> DataFrame:
    """Percentage of observed minutes per participant, day and channel."""
    seen = minutes.where(A.observed(F.col("value")))
    return seen.groupBy(*KEY).agg(
        (F.count("*") * F.lit(100.0) / C.MINUTES_PER_DAY).alias("data_coverage")
    )


def day_stats(minutes: DataFrame, days: DataFrame) -> DataFrame:
    """24 rows per output day: coverage, n, sum, sum of squares, original offset."""
    per_channel = channel_statistics(minutes)
    per_day = per_channel.groupBy("participant_id", "date").agg(
        F.map_from_entries(
            F.collect_list(F.struct("channel_idx", F.struct("n", "sum", "sum_of_squares").alias("s")))
        ).alias("stats")
    )
    zero = F.lit(0.0)
    return (
        days.select("participant_id", "date", "original_time_offset")
        .join(per_day, ["participant_id", "date"], "left")
        .select(
            "participant_id",
            "date",
            "original_time_offset",
            "stats",
            F.explode(F.sequence(F.lit(0), F.lit(C.N_CHANNELS - 1))).alias("feature_index"),
        )
        .withColumn("s", F.col("stats")[F.col("feature_index")])
        .select(
            "participant_id",
            "date",
            "feature_index",
            F.coalesce(F.col("s.n") * 100 / C.MINUTES_PER_DAY, zero).alias("data_coverage"),
            F.coalesce("s.n", zero).alias("n"),
            F.coalesce("s.sum", zero).alias("sum"),
            F.coalesce("s.sum_of_squares", zero).alias("sum_of_squares"),
            "original_time_offset",
        )
    )


def standardization(stats: DataFrame) -> DataFrame:
    """Global mean and standard deviation per channel from the partial sums.

    Rows with a missing statistic are skipped; a channel without observations gets NULL. The sums merge
    map-side, so 24 rows per task reach the shuffle.
    """
    required = ["n", "sum", "sum_of_squares"]
    complete = stats
    for c in required:
        complete = complete.where(F.col(c).isNotNull() & ~F.isnan(c))
    totals = complete.groupBy("feature_index").agg(
        F.sum("n").alias("n"), F.sum("sum").alias("s"), F.sum("sum_of_squares").alias("q")
    )
    mean = F.try_divide("s", "n")
    variance = F.try_divide("q", "n") - mean * mean
    return totals.select(
        "feature_index",
        mean.alias("mean"),
        F.when(variance.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), variance))).alias("std_dev"),
    )


def standardization_from_sources(sources: list[DataFrame]) -> DataFrame:
    """As above over several tables; a table lacking a column, or with text in it, is skipped."""
    required = ["n", "sum", "sum_of_squares"]
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    usable = []
    for df in sources:
        types = dict(df.dtypes)
        known = "feature_index" in types and all(types.get(c) in numeric for c in required)
        if known:
            usable.append(
                df.select("feature_index", *[F.col(c).cast("double").alias(c) for c in required])
            )
    if not usable:
        raise ValueError("no source has feature_index, n, sum and sum_of_squares")
    out = usable[0]
    for df in usable[1:]:
        out = out.unionByName(df)
    return standardization(out)


def day_summary(stats: DataFrame) -> DataFrame:
    """Coverage sum and mean and the number of channels with data, per participant-day."""
    return stats.groupBy("participant_id", "date").agg(
        F.sum("data_coverage").alias("data_coverage_sum"),
        F.avg("data_coverage").alias("data_coverage_mean"),
        F.count_if(F.col("data_coverage") > 0).alias("n_above_zero"),
    )


def group_coverage(stats: DataFrame) -> DataFrame:
    """Coverage sum per participant-day for each channel group, one column per group."""
    sums = []
    for group, channels in C.CHANNEL_GROUPS.items():
        indices = [C.CHANNEL_INDEX[c] for c in channels]
        sums.append(
            F.sum(
                F.when(F.col("feature_index").isin(*indices), F.col("data_coverage")).otherwise(0.0)
            ).alias(f"{group}_coverage_sum")
        )
    return stats.groupBy("participant_id", "date").agg(*sums)


def group_report(by_group: DataFrame) -> DataFrame:
    """Days with coverage, participants and estimated data points per channel group, most days first.

    Participants are counted from one row per participant and group, not by a distinct over days.
    """
    groups = list(C.CHANNEL_GROUPS)
    long = by_group.unpivot(
        ["participant_id"], [f"{g}_coverage_sum" for g in groups], "modality_group", "coverage"
    )
    per_participant = long.groupBy("modality_group", "participant_id").agg(
        F.count_if(F.col("coverage") > 0).alias("days"),
        # Coverage is a share of whole minutes; summed as such, the order of summation doesn't matter.
        F.sum(F.round(F.col("coverage") * (C.MINUTES_PER_DAY / 100)).cast("long")).alias("minutes"),
    )
    return (
        per_participant.groupBy("modality_group")
        .agg(
            F.sum("days").alias("days_with_coverage"),
            F.count_if(F.col("days") > 0).alias("unique_participants"),
            F.sum("minutes").alias("estimated_data_points"),
        )
        .withColumn("modality_group", F.regexp_replace("modality_group", "_coverage_sum$", ""))
        .orderBy(F.desc("days_with_coverage"), "modality_group")
    )


def days_per_participant(summary: DataFrame) -> DataFrame:
    return summary.groupBy("participant_id").agg(
        F.count_distinct("date").alias("n_days"), F.count("*").alias("n_rows")
    )


def threshold_ladders(summary: DataFrame) -> DataFrame:
    """Participants with more than t days; days with at least k channels; participants with a day of
    more than k channels. One pass per ladder, no join with the thresholds."""
    per_participant = summary.groupBy("participant_id").agg(
        F.count("*").alias("days"), F.max("n_above_zero").alias("channels")
    )

    def ladder(df, name, thresholds, condition):
        one_row = df.agg(*[F.count_if(condition(t)).alias(str(t)) for t in thresholds])
        return one_row.unpivot([], [str(t) for t in thresholds], "threshold", "n").select(
            F.lit(name).alias("ladder"), F.col("threshold").cast("int"), "n"
        )

    return (
        ladder(
            per_participant,
            "participants_with_more_days",
            C.PARTICIPANT_DAY_THRESHOLDS,
            lambda t: F.col("days") > t,
        )
        .unionByName(
            ladder(
                summary,
                "days_with_at_least_channels",
                C.CHANNEL_COUNT_THRESHOLDS,
                lambda k: F.col("n_above_zero") >= k,
            )
        )
        .unionByName(
            ladder(
                per_participant,
                "participants_with_more_channels",
                C.CHANNEL_COUNT_THRESHOLDS,
                lambda k: F.col("channels") > k,
            )
        )
    )


def coverage_quantile(summary: DataFrame, probability: float = 0.25) -> DataFrame:
    return exact_quantiles(summary, [], "data_coverage_sum", [probability]).select(
        "probability", F.col("quantile").alias("data_coverage_sum")
    )


def selected_days(summary: DataFrame, probability: float = 0.25, more_channels_than: int = 4) -> DataFrame:
    """Days above the coverage quantile with more than the given number of channels."""
    threshold = coverage_quantile(summary, probability).select("data_coverage_sum")
    return summary.where(
        (F.col("data_coverage_sum") > threshold.scalar())
        & (F.col("n_above_zero") > more_channels_than)
    )


def days_with_any_data(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("data_coverage_sum") > 0)


def array_summary(df: DataFrame, values: str) -> DataFrame:
    """Valid and missing counts, min, max and mean of an array column over all rows.

    Each array is reduced in its row; only partial results are aggregated.
    """
    valid = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    per_row = df.select(
        F.size(valid).alias("valid"),
        (F.size(values) - F.size(valid)).alias("missing"),
        F.array_min(valid).cast("double").alias("lo"),
        F.array_max(valid).cast("double").alias("hi"),
        F.aggregate(valid, F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total"),
    )
    return per_row.agg(
        F.sum("valid").alias("n_valid"),
        F.sum("missing").alias("n_nan"),
        F.min("lo").alias("min_value"),
        F.max("hi").alias("max_value"),
        F.try_divide(F.sum("total"), F.sum("valid")).alias("mean_value"),
    )


def describe(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of each column per group.

    ``group`` must be a fixed enumeration such as the split name.
    """
    q = [F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))]
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std")
    out = summaries(df, group, columns, [0.25, 0.5, 0.75]).where("n > 0")
    return out.select(*group, "variable", "n", "mean", spread, "min", "max", *q)


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Absolute and relative frequency of each value. NULL is not counted."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")
    )
    total = counts.agg(F.sum("n").alias("total"))
    return counts.withColumn("share", F.col("n") / total.scalar())
