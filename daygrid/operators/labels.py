"""Survey labels: parsing, nearest-in-time join, nested and flat forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid import constants as C

NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def parse_list(text: Column) -> Column:
    """``[1, 2]`` and ``[1. 10.]`` to array<double>; ``[]`` to an empty array; anything else to NULL.

    One separator kind per list: commas, or white space.
    """
    item = F.trim(text)
    inner = F.trim(F.regexp_extract(item, r"^\[(.*)\]$", 1))
    by_comma = F.rlike(inner, F.lit(rf"^{NUMBER}(\s*,\s*{NUMBER})*\s*,?$"))
    by_space = F.rlike(inner, F.lit(rf"^{NUMBER}(\s+{NUMBER})+$"))
    pieces = F.filter(F.split(inner, r"[,\s]+"), lambda x: x != "")
    numbers = F.transform(pieces, lambda x: x.try_cast("double"))
    return F.when(
        F.rlike(item, F.lit(r"^\[.*\]$")),
        F.when(inner == "", F.array().cast("array<double>")).when(by_comma | by_space, numbers),
    )


def label_columns(df: DataFrame) -> list[str]:
    """Every column that is not a key."""
    return [c for c in df.columns if c not in (*C.LABEL_KEY_COLUMNS, "seq", "pos")]


def explode_list_label(df: DataFrame, column: str) -> DataFrame:
    """One row per list element; an empty or missing list gives one NULL row.

    ``pos`` is the element's position, so the input order stays known.
    """
    others = [c for c in df.columns if c not in (column, "pos")]
    out = df.select(*others, F.posexplode_outer(parse_list(F.col(column))).alias("pos", column))
    return out.select(*[c for c in df.columns if c != "pos"], F.coalesce("pos", F.lit(0)).alias("pos"))


def to_whole(value: Column) -> Column:
    """Truncate towards zero, NULL kept."""
    v = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")


def prepare_labels(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Parse and explode the list labels, truncate all labels. Keeps ``seq`` as the input order."""
    labels = labels or label_columns(df)
    df = df.withColumn("pos", F.lit(0))
    for c in C.LIST_LABELS:
        if c in labels and dict(df.dtypes).get(c) == "string":
            df = explode_list_label(df, c)
    return df.withColumns({c: to_whole(F.col(c)) for c in labels if c in df.columns})


def long_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    present = [c for c in labels if c in df.columns]
    return df.unpivot(
        ["participant_id", "created_on", "seq", "pos"],
        [F.col(c).cast("double").alias(c) for c in present],
        "label",
        "value",
    ).where(F.col("value").isNotNull())


def nearest_label(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """For each window and label the answer whose date is nearest to the window's midpoint.

    No distance limit; on equal distance the earlier date wins. Of several answers on one date, the first
    in input order is used at or after the midpoint and the last before it.

    Answers are first reduced to one row per participant, label and date (first and last answer), windows
    to distinct ranges. Both are then merged on one time axis and the answer before / after is carried
    with ``last ... ignore nulls`` in both directions, so no (window, answer) pairs are formed.
    Positions are in half days, so midpoints are whole numbers.
    """
    answer = F.struct("value", "created_on")
    per_date = (
        labels.withColumn("_day", F.unix_date(F.to_date("created_on")))
        .groupBy("participant_id", "label", "_day")
        .agg(
            F.min_by(answer, F.struct("seq", "pos")).alias("first"),
            F.max_by(answer, F.struct("seq", "pos")).alias("last"),
        )
    )
    ranges = windows.select("participant_id", "start_date", "end_date").distinct()
    asked = ranges.join(labels.select("participant_id", "label").distinct(), "participant_id")
    entry = "struct<value:double,created_on:timestamp_ntz>"
    points = per_date.select(
        "participant_id",
        "label",
        (F.col("_day") * 2).alias("pos"),
        F.lit(1).alias("kind"),
        "first",
        "last",
        F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
    ).unionByName(
        asked.select(
            "participant_id",
            "label",
            (F.unix_date("start_date") + F.unix_date("end_date")).alias("pos"),
            F.lit(0).alias("kind"),
            F.lit(None).cast(entry).alias("first"),
            F.lit(None).cast(entry).alias("last"),
            "start_date",
            "end_date",
        )
    )
    key = Window.partitionBy("participant_id", "label")
    forward = key.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    backward = key.orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("kind") == 1, F.struct("pos", "first", "last"))
    merged = (
        points.withColumn("before", F.last(known, ignorenulls=True).over(forward))
        .withColumn("after", F.last(known, ignorenulls=True).over(backward))
        .where("kind = 0")
    )
    use_after = F.col("before").isNull() | (
        F.col("after").isNotNull()
        & ((F.col("after.pos") - F.col("pos")) < (F.col("pos") - F.col("before.pos")))
    )
    chosen = F.when(use_after, F.col("after.first")).otherwise(F.col("before.last"))
    return merged.select("participant_id", "start_date", "end_date", "label", chosen.alias("match")).select(
        "participant_id",
        "start_date",
        "end_date",
        "label",
        F.col("match.value").alias("label_value"),
        F.col("match.created_on").alias("label_date"),
    )


def labelled_windows(windows: DataFrame, label_df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Nested form: one struct column per label; windows without any label are kept."""
    labels = labels or C.LABELS
    matches = nearest_label(windows, long_labels(prepare_labels(label_df, labels), labels))
    wide = matches.groupBy("participant_id", "start_date", "end_date").agg(
        *[
            F.first(
                F.when(F.col("label") == name, F.struct("label_value", "label_date")), ignorenulls=True
            ).alias(name)
            for name in labels
        ]
    )
    return windows.join(wide, ["participant_id", "start_date", "end_date"], "left")


def flatten_labels(nested: DataFrame, labels: list[str] | None = None) -> DataFrame:
    labels = labels or C.LABELS
    others = [c for c in nested.columns if c not in labels]
    return nested.select(
        *others,
        *[F.col(f"{c}.label_value").alias(f"{c}_value") for c in labels],
        *[F.col(f"{c}.label_date").alias(f"{c}_date") for c in labels],
    )


def nest_labels(flat: DataFrame, labels: list[str] | None = None) -> DataFrame:
    labels = labels or C.LABELS
    others = [
        c for c in flat.columns if c not in {f"{x}_{s}" for x in labels for s in ("value", "date")}
    ]
    return flat.select(
        *others,
        *[
            F.when(
                F.col(f"{c}_value").isNotNull(),
                F.struct(
                    F.col(f"{c}_value").alias("label_value"), F.col(f"{c}_date").alias("label_date")
                ),
            ).alias(c)
            for c in labels
        ],
    )


def with_label(flat: DataFrame, label: str) -> DataFrame:
    """Windows where a label is present; the name may carry the ``_value`` suffix."""
    column = label if label.endswith("_value") else f"{label}_value"
    if column not in flat.columns:
        raise ValueError(f"no label column {column}")
    return flat.where(F.col(column).isNotNull() & ~F.isnan(column))


def value_columns(flat: DataFrame) -> list[str]:
    return [c for c in flat.columns if c.endswith("_value")]


def labels_present(flat: DataFrame) -> DataFrame:
    """Number of different labels each participant has at least once."""
    columns = value_columns(flat)
    present = flat.groupBy("participant_id").agg(
        *[F.bool_or(F.col(c).isNotNull()).alias(c) for c in columns]
    )
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).cast("int")
    return present.select("participant_id", total.alias("label_count"))


def label_means(flat: DataFrame) -> DataFrame:
    return flat.groupBy("participant_id").agg(*[F.avg(c).alias(c) for c in value_columns(flat)])


def participants_without_labels(flat: DataFrame) -> DataFrame:
    """Participants with a window lacking every label, and whether all their windows do."""
    none = F.coalesce(*[F.col(c) for c in value_columns(flat)]).isNull()
    return (
        flat.groupBy("participant_id")
        .agg(F.bool_or(none).alias("any_window"), F.bool_and(none).alias("all_windows"))
        .where("any_window")
        .drop("any_window")
    )
