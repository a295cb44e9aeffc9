"""Model-ready series records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import arrays as A
from daygrid.functions.ranking import bucketed_row_number, md5_bucket
from daygrid.operators.days import joined_cells
from daygrid.operators.post import masked_to_nan
from daygrid.operators.samples import SAMPLE, gathered

SERIES_SCHEMA = (
    "target array<array<float>>, start timestamp, freq string, item_id string, "
    "feat_static_real array<float>, feat_dynamic_real array<array<float>>"
)


def numbered_windows(windows: DataFrame) -> DataFrame:
    """Windows with a row number in (participant digest bucket, participant, start) order, from 0."""
    return bucketed_row_number(
        windows,
        [],
        md5_bucket(F.col("participant_id").cast("string")),
        [F.col("participant_id"), F.col("start_date")],
        "_n",
    ).withColumn("row_number", F.col("_n") - 1).drop("_n")


def static_features(row_labels: list[str]) -> Column:
    """Label values sorted by name, NULL as NaN."""
    return F.array(
        *[F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) for c in sorted(row_labels)]
    )


def series_records(
    flat: DataFrame,
    numbered: DataFrame,
    labels: list[str] = (),
    masked_as_nan: bool = False,
    include_mask: bool = True,
    features: int | None = None,
) -> DataFrame:
    """One record per sample: target [channel][time], start, freq, item id, label and mask features.

    ``flat`` holds one flattened row per channel, so a record gathers at most 24 arrays; where its rows have ``entries``, the
    days' runs, these are gathered and numbered, and the record's arrays are made of them last. A sample whose
    number of channels differs from the expected one, or whose range is not valid, is skipped.
    """
    by_runs = "entries" in flat.columns
    values = masked_to_nan(F.col("values"), F.col("mask")) if masked_as_nan else F.col("values")
    fields = [A.mapped(values, lambda v: v.cast("float")).alias("v")]
    if include_mask:
        fields.append(A.mapped("mask", lambda m: m.cast("float")).alias("m"))
    rows = flat.select(*SAMPLE, F.col("channel_idx").alias("i"), *(["entries"] if by_runs else fields))
    expected = features if features is not None else C.N_CHANNELS
    whole = (F.size("_g") == expected) & (F.col("start_date") <= F.col("end_date"))
    joined = gathered(rows, SAMPLE, "i", [c for c in rows.columns if c in ("v", "m", "entries")]).where(whole).join(numbered, SAMPLE)
    targets, masks = F.col("_g.v"), F.col("_g.m") if include_mask else None
    if by_runs:
        made = [joined_cells(F.get("_g", F.lit(k))["entries"], masked_as_nan, "float") for k in range(expected)]
        targets, masks = (F.array(*x) for x in zip(*made, strict=True))
    columns = [
        targets.alias("target"),
        F.col("start_date").cast("timestamp").alias("start"),
        F.lit(C.SERIES_FREQ).alias("freq"),
        F.concat_ws("_", F.col("participant_id").cast("string"), F.col("row_number").cast("string")).alias(
            "item_id"
        ),
    ]
    if labels:
        columns.append(static_features(list(labels)).alias("feat_static_real"))
    if include_mask:
        columns.append(masks.alias("feat_dynamic_real"))
    return joined.select(*columns)


def feature_count(flat: DataFrame) -> DataFrame:
    """Number of channels per sample, to fix the schema; more than one row means uneven samples."""
    return (
        flat.groupBy(*SAMPLE)
        .agg(F.count_distinct("channel_idx").alias("features"))
        .groupBy("features")
        .agg(F.count("*").alias("samples"))
    )
