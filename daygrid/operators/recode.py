"""Participant attributes: age, bins, de-duplication, label coarsening, device class, features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions.numbers import bin_label, holds, nan_to_null
from daygrid.functions.quantiles import summaries


def age_years(created_on: Column, birthdate: Column) -> Column:
    """Whole 24-hour days between the two, in years of 365.25 days, rounded half to even."""
    created, born = created_on.try_cast("timestamp"), birthdate.try_cast("timestamp")
    days = F.floor((F.unix_micros(created) - F.unix_micros(born)) / F.lit(86_400_000_000))
    return F.bround(days / F.lit(C.DAYS_PER_YEAR), 0).cast("int")


def with_age(info: DataFrame) -> DataFrame:
    return info.withColumn("age", age_years(F.col("created_on"), F.col("birthdate")))


def age_group(age: Column, fine: bool = False) -> Column:
    edges, names = C.AGE_BINS_FINE if fine else C.AGE_BINS
    return bin_label(age, edges, names, C.UNKNOWN_AGE)


def weight_group(weight: Column) -> Column:
    return bin_label(weight, *C.WEIGHT_BINS, C.UNKNOWN_WEIGHT)


def height_group(height: Column) -> Column:
    return bin_label(height, *C.HEIGHT_BINS, C.UNKNOWN_HEIGHT)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a stated order, as a mergeable aggregate (no per-key sort)."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(row, F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def most_complete(df: DataFrame, key: str = "participant_id", tiebreak: str = "row_no") -> DataFrame:
    """The row with the fewest missing values per key."""
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + F.col(c).isNull().cast("int")
    return first_per_key(df, [key], [missing.alias("missing"), F.col(tiebreak)])


def duplicated_rows(df: DataFrame, key: str = "participant_id") -> DataFrame:
    """All rows whose key occurs more than once."""
    repeated = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return df.join(repeated, key, "left_semi")


# --- label coarsening and its text form ---------------------------------------------------------------


@dataclass(frozen=True)
class Answers:
    """How the sparse answers of one label are merged: those that ``sparse`` selects count as ``merged``.

    Merged answers read ``merged_text``; the others read ``text``, with ``{}`` for the number.
    """

    sparse: Callable[[Column], Column]
    merged: int
    merged_text: str
    text: str


#: One rule per label; labels without one keep their numbers (fixed values).
ANSWERS = {
    "happiness": Answers(lambda v: v < 5, 4, "≤4 (Low)", "{} (High)"),
    "feel_worthwhile1": Answers(lambda v: v < 4, 3, "≤3 (Low)", "{} (High)"),
    "feel_worthwhile2": Answers(lambda v: v < 4, 3, "≤3 (Low)", "{} (High)"),
    "feel_worthwhile3": Answers(lambda v: v.isin(9, 10), 9, "9-10 (High)", "{}"),
    "heart_disease": Answers(lambda v: v != 10, 0, "Other Heart Disease", "{}"),
}


def _rule(column: str) -> Answers | None:
    return ANSWERS.get(column.removesuffix("_value"))


def coarse_label(column: str, value: Column) -> Column:
    """Merge sparse answers. ``value`` is a rounded mean; missing stays missing."""
    rule = _rule(column)
    return value if rule is None else F.when(rule.sparse(value), F.lit(rule.merged)).otherwise(value)


def label_text(column: str, value: Column) -> Column:
    """Text of a coarse answer."""
    rule = _rule(column)
    number = value.cast("int").cast("string")
    if rule is not None:
        before, _, after = rule.text.partition("{}")
        plain = F.concat(F.lit(before), number, F.lit(after))
        number = F.when(value == rule.merged, F.lit(rule.merged_text)).otherwise(plain)
    return F.coalesce(number, F.lit(C.MISSING))


def coarse_means(means: DataFrame) -> DataFrame:
    """Label means rounded half to even, then coarsened."""
    columns = [c for c in means.columns if c.endswith("_value")]
    return means.select(
        "participant_id",
        *[coarse_label(c, F.bround(F.col(c), 0).cast("int")).cast("int").alias(c) for c in columns],
    )


def label_texts(coarse: DataFrame) -> DataFrame:
    columns = [c for c in coarse.columns if c.endswith("_value")]
    return coarse.select(
        "participant_id", *[label_text(c, F.col(c)).alias(f"{c}_str") for c in columns]
    )


# --- record sources -----------------------------------------------------------------------------------


def dominant_app_version(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the records of the most frequent app version per group (lowest version on equal counts).

    A group without any version is kept unchanged. Versions are counted with partial aggregation and the
    winner is a ``max_by``; records meet again only through an equi-join.
    """
    counts = df.groupBy(*keys, "app_version").agg(F.count("*").alias("_n"))
    winner = counts.where("app_version IS NOT NULL").groupBy(*keys).agg(
        F.min_by("app_version", F.struct((-F.col("_n")).alias("n"), "app_version")).alias("_winner")
    )
    left = df.alias("l")
    right = winner.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_winner")
    condition = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        condition = c if condition is None else condition & c
    return (
        left.join(right, condition, "left")
        .where(F.col("_winner").isNull() | holds(F.col("app_version") == F.col("_winner")))
        .drop("_winner", *[f"_k_{k}" for k in keys])
    )


def device_classes(records: DataFrame) -> DataFrame:
    """Class of each participant's sources: watch when it reports heart rate, else phone, else Unknown."""
    own = F.contains(F.col("source_identifier"), F.lit("com.apple.health."))
    quantity = F.col("modality") == C.QUANTITY
    heart = F.col("type") == C.HEART_RATE
    return (
        records.groupBy("participant_id", "source")
        .agg(
            F.bool_or(quantity & own & heart).alias("watch"),
            F.bool_or(quantity & own & ~heart).alias("phone"),
        )
        .select(
            "participant_id",
            "source",
            F.when(F.col("watch"), "AppleWatch")
            .when(F.col("phone"), "iPhone")
            .otherwise("Unknown")
            .alias("device"),
        )
    )


def with_device(records: DataFrame) -> DataFrame:
    return records.join(device_classes(records), ["participant_id", "source"])


def top_devices(df: DataFrame, n: int = 5, column: str = "device") -> DataFrame:
    """The ``n`` values with most records, listed alphabetically."""
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
        .orderBy(column)
    )


# --- model features -----------------------------------------------------------------------------------


def scaled_features(df: DataFrame, numeric: list[str], category: str) -> DataFrame:
    """Median imputation and scaling of numeric columns, one-hot category with a Missing level.

    NULL and NaN are missing. Moments of the filled column follow from those of its values, so they come with the median
    from one call; the row with all of them reaches the data as a scalar subquery. A column without any value becomes
    zero, a column without spread is only centred.
    """
    found = summaries(df, [], numeric, [0.5])
    median = F.coalesce(F.get("quantiles", F.lit(0)), F.lit(0.0))
    held, missing = F.col("n"), F.col("n_missing")
    own = F.coalesce("mean", F.lit(0.0))
    mean = F.coalesce(F.try_divide(held * own + missing * median, held + missing), F.lit(0.0))
    squares = F.coalesce("m2", F.lit(0.0)) + held * (own - mean) * (own - mean) + missing * (median - mean) * (median - mean)
    moments = F.struct(median.alias("median"), mean.alias("mean"), F.sqrt(F.try_divide(squares, held + missing)).alias("std"))
    one_row = found.agg(F.struct(*[F.max(F.when(F.col("variable") == c, moments)).alias(c) for c in numeric]).alias("s"))
    scaled = df.withColumn("_s", one_row.scalar()).withColumns(
        {
            c: (F.coalesce(nan_to_null(F.col(c).cast("double")), F.col(f"_s.{c}.median")) - F.col(f"_s.{c}.mean"))
            / F.when(F.col(f"_s.{c}.std") > 0, F.col(f"_s.{c}.std")).otherwise(F.lit(1.0))
            for c in numeric
        }
    )
    value = F.coalesce(F.col(category), F.lit(C.MISSING))
    return scaled.withColumn(category, value).drop("_s")


def one_hot(df: DataFrame, category: str, levels: list[str]) -> DataFrame:
    return df.withColumns(
        {f"{category}_{v}": (F.col(category) == v).cast("double") for v in levels}
    )
