"""Per-device and per-activity summaries of local-time records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import time as T
from daygrid.functions.numbers import nan_to_null
from daygrid.functions.quantiles import summaries


def robust_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum, mean, median, quartiles and interquartile range of ``value``.

    ``keys`` are fixed enumerations (device class, record type).
    """
    q = [F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(("q25", "median", "q75"))]
    out = summaries(df, keys, ["value"], [0.25, 0.5, 0.75]).where("n > 0").select(*keys, "sum", "mean", *q)
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


def hourly_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean per hour over 24 fixed hours; hours without records are NULL."""
    hour = T.floor_div(T.micros_of_day(F.col("start_us")), T.HOUR).cast("int")
    means = df.groupBy(*keys, hour.alias("hour")).agg(F.avg("value").alias("mean_value"))
    days = df.select(*keys).distinct().withColumn(
        "hour", F.explode(F.sequence(F.lit(0), F.lit(23)))
    )
    return days.join(means, [*keys, "hour"], "left")


def sleep_seconds(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(F.when(F.col("category") == C.IN_BED, F.col("value"))).alias("seconds_in_bed"),
        F.sum(F.when(F.col("category") == C.ASLEEP, F.col("value"))).alias("seconds_asleep"),
    )


def _seconds_by(df: DataFrame, keys: list[str], column: str, names: list[str]) -> DataFrame:
    """Seconds per name; every name is listed for every key, zero when it has no record."""
    seconds = df.groupBy(*keys, column).agg(
        F.sum(T.seconds_between(F.col("start_us"), F.col("end_us"))).alias("delta")
    )
    listed = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("position", column)
    if keys:
        groups = df.select(*keys).distinct().select(*keys, listed)
        return groups.join(seconds, [*keys, column], "left").withColumn(
            "delta", F.coalesce("delta", F.lit(0.0))
        )
    one = df.sparkSession.range(1).select(listed)
    return one.join(F.broadcast(seconds.where(F.col(column).isin(*names))), column, "left").withColumn(
        "delta", F.coalesce("delta", F.lit(0.0))
    )


def workout_seconds(df: DataFrame, keys: list[str]) -> DataFrame:
    return _seconds_by(df, keys, "workout_type", C.WORKOUT_TYPES).drop("position")


def motion_seconds(df: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds per activity with its place in the report."""
    return _seconds_by(df, keys, "activity", C.MOTION_REPORT_ORDER)


def summary_for(kind: str):
    """Summary function of a record kind: a quantity type or a modality."""
    if kind == C.HEART_RATE:
        return hourly_means
    if kind in C.QUANTITY_TYPES:
        return robust_stats
    return {C.SLEEP: sleep_seconds, C.WORKOUT: workout_seconds, C.MOTION: motion_seconds}[kind]


#: Figures of each kind of summary: name of the figure, column of ``summaries``.
KIND_FIGURES = {
    "robust": {"sum": "sum", "mean": "mean", "q25": "q25", "median": "median", "q75": "q75", "iqr": "iqr"},
    "hourly": {"mean_value": "mean"},
    "sleep": {"seconds": "sum"},
    "workout": {"delta": "sum"},
    "motion": {"delta": "sum"},
}
#: Names that a report lists although they have no record, and what they then show.
KIND_NAMES = {
    "hourly": [f"{h:02d}" for h in range(24)],
    "sleep": [C.IN_BED, C.ASLEEP],
    "workout": C.WORKOUT_TYPES,
    "motion": C.MOTION_REPORT_ORDER,
}


def summaries_by_kind(df: DataFrame) -> DataFrame:
    """All figures of the summaries of every kind of record: ``kind, name, figure, amount``, from one expansion.

    A record adds one row (kind, name, amount): its hour for heart rate, its type, category or activity otherwise.
    Listed names join that expansion as rows without an amount, so they need no join. Sums and quantiles of all kinds
    come from the same three scans. Seconds of absent names are 0, means of absent hours NULL.
    """
    modality = F.col("modality")
    hour = F.lpad(T.floor_div(T.micros_of_day(F.col("start_us")), T.HOUR).cast("string"), 2, "0")
    seconds = T.seconds_between(F.col("start_us"), F.col("end_us"))
    heart = (modality == C.QUANTITY) & (F.col("type") == C.HEART_RATE)

    def row(kind, name, amount):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), amount.cast("double").alias("amount"))

    made = (
        F.when(heart, row("hourly", hour, F.col("value")))
        .when(modality == C.QUANTITY, row("robust", F.col("type"), F.col("value")))
        .when(modality == C.SLEEP, row("sleep", F.col("category"), F.col("value")))
        .when(modality == C.WORKOUT, row("workout", F.col("workout_type"), seconds))
        .when(modality == C.MOTION, row("motion", F.col("activity"), seconds))
    )
    rows = df.select(made.alias("_r")).where(F.col("_r.name").isNotNull()).select("_r.*")
    listed = [(kind, name, None) for kind, names in KIND_NAMES.items() for name in names]
    rows = rows.unionByName(df.sparkSession.createDataFrame(listed, "kind string, name string, amount double"))
    q = [F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(("q25", "median", "q75"))]
    found = summaries(rows, ["kind", "name"], ["amount"], [0.25, 0.5, 0.75])
    found = found.select("kind", "name", "mean", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("sum")).alias("sum"), *q)
    found = found.withColumn("iqr", F.col("q75") - F.col("q25"))
    figure = lambda f, c: F.struct(F.lit(f).alias("figure"), F.col(c).alias("amount"))
    figures = F.array()
    for kind, own in reversed(KIND_FIGURES.items()):
        each = F.array(*[figure(f, c) for f, c in own.items()])
        figures = each if kind == "motion" else F.when(F.col("kind") == kind, each).otherwise(figures)
    return found.select("kind", "name", F.inline(figures))


def units_per_type(df: DataFrame) -> DataFrame:
    """Distinct units and record count of each record type (units are an enumeration)."""
    return df.groupBy("type").agg(
        F.array_sort(F.collect_set("unit")).alias("units"), F.count("*").alias("records")
    )


def resample_minutes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One record per device and minute: mean value, other columns from the first record."""
    minute = F.col("start_us") - F.pmod("start_us", F.lit(T.MINUTE))
    first = F.struct("start_us", "record_id")
    carried = [c for c in ("unit", "app_version", "source") if c in df.columns and c not in keys]
    return (
        df.groupBy(*keys, minute.alias("minute_us"))
        .agg(
            F.avg(nan_to_null(F.col("value"))).alias("value"),
            F.count("*").alias("records"),
            F.min_by(F.struct(*carried), first).alias("_f"),
        )
        .select(
            *keys,
            F.col("minute_us").alias("start_us"),
            (F.col("minute_us") + T.MINUTE).alias("end_us"),
            "value",
            "records",
            "_f.*",
        )
    )


def first_complete_day(df: DataFrame) -> DataFrame:
    """Per participant the first day on which every non-empty modality except motion has a record, else
    the first quantity day. Participants without quantity records have none."""
    relevant = df.where(F.col("modality").isin(C.QUANTITY, C.WORKOUT, C.SLEEP))
    kinds = {C.QUANTITY: 1, C.WORKOUT: 2, C.SLEEP: 4}
    bit = F.lit(0)
    for name, value in kinds.items():
        bit = F.when(F.col("modality") == name, F.lit(value)).otherwise(bit)
    days = relevant.groupBy("participant_id", "date").agg(F.bit_or(bit).alias("bits"))
    present = days.groupBy("participant_id").agg(F.bit_or("bits").alias("all_bits"))
    return (
        days.join(present, "participant_id")
        .where(F.col("all_bits").bitwiseAND(F.lit(1)) == 1)
        .groupBy("participant_id")
        .agg(
            F.min(F.when(F.col("bits") == F.col("all_bits"), F.col("date"))).alias("complete"),
            F.min(F.when(F.col("bits").bitwiseAND(F.lit(1)) == 1, F.col("date"))).alias("quantity"),
        )
        .select("participant_id", F.coalesce("complete", "quantity").alias("date"))
    )


def records_of_first_day(df: DataFrame) -> DataFrame:
    return df.join(first_complete_day(df), ["participant_id", "date"], "left_semi")
