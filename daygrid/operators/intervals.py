"""Splitting records at local midnight and describing which days and channels exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import time as T
from daygrid.functions.numbers import holds
from daygrid.operators.clean import sleep_end_from_duration

OFFSET_RANGE = 1 << 20


def split_at_midnight(df: DataFrame) -> DataFrame:
    """Cut a record that ends on another date than it starts in two, at the midnight before its end.

    The first part ends two seconds before that midnight. Values other than heart rate are shared out by
    duration, each share clamped to [0, 1]. A record ending exactly at midnight leaves an empty second
    part, which still makes the next day exist. Row-local: one generator, no shuffle.
    """
    start, end = F.col("start_us"), F.col("end_us")
    midnight = T.day_start(end)
    crosses = holds(T.day_start(start) != midnight)
    first_end = midnight - C.SPLIT_GAP_SECONDS * T.SECOND
    has_value = "value" in df.columns

    def part(number, s, e):
        fields = [F.lit(number).alias("part"), s.alias("start_us"), e.alias("end_us")]
        if has_value:
            share = F.greatest(
                F.lit(0.0), F.least(F.lit(1.0), F.try_divide(e - s, end - start))
            )
            shared = F.when(end > start, F.col("value") * share).otherwise(F.lit(0.0))
            if "type" in df.columns:
                shared = F.when(F.col("type") == C.HEART_RATE, F.col("value")).otherwise(shared)
            fields.append(shared.alias("value"))
        return F.struct(*fields)

    whole = F.struct(
        F.lit(0).alias("part"),
        start.alias("start_us"),
        end.alias("end_us"),
        *([F.col("value").alias("value")] if has_value else []),
    )
    parts = F.when(crosses, F.array(part(0, start, first_end), part(1, midnight, end))).otherwise(
        F.array(whole)
    )
    others = [c for c in df.columns if c not in ("start_us", "end_us", "value")]
    return df.select(*others, F.inline(parts))


def split_sleep_at_midnight(df: DataFrame) -> DataFrame:
    """Sleep variant: the end comes from the duration, and each part's value is its own duration."""
    out = split_at_midnight(sleep_end_from_duration(df))
    return out.withColumn("value", T.seconds_between(F.col("start_us"), F.col("end_us")))


def split_union_at_midnight(df: DataFrame) -> DataFrame:
    """Both variants over a union table in one pass."""
    out = split_at_midnight(sleep_end_from_duration(df))
    return out.withColumn(
        "value",
        F.when(
            F.col("modality") == C.SLEEP, T.seconds_between(F.col("start_us"), F.col("end_us"))
        ).otherwise(F.col("value")),
    )


def with_local_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", T.date_of(F.col("start_us")))


def channel_index() -> Column:
    """Position of a record's channel, NULL for unknown kinds. Names are unique across modalities."""
    name = (
        F.when(F.col("modality") == C.QUANTITY, F.col("type"))
        .when(F.col("modality") == C.WORKOUT, F.col("workout_type"))
        .when(F.col("modality") == C.SLEEP, F.col("category"))
        .otherwise(F.col("activity"))
    )
    position = F.array_position(F.array(*[F.lit(c) for c in C.CHANNELS]), name)
    return F.nullif(position, F.lit(0)).cast("int") - 1


def with_channel(df: DataFrame) -> DataFrame:
    return df.withColumn("channel_idx", channel_index())


def _first_offset() -> Column:
    """Offset of the earliest quantity record (smallest offset on equal starts) as one packed long.

    Packing (microsecond of day, offset) keeps this a primitive ``min`` that hash-aggregates in place.
    """
    packed = T.micros_of_day(F.col("start_us")) * OFFSET_RANGE + (
        F.col("start_offset") + OFFSET_RANGE // 2
    )
    return F.min(F.when(F.col("modality") == C.QUANTITY, packed))


def _unpack_offset(packed: Column) -> Column:
    return (packed % OFFSET_RANGE - OFFSET_RANGE // 2).cast("int")


def day_index(parts: DataFrame, skip_quantity: bool = False) -> DataFrame:
    """One row per output day: the channels it has records of, and its original offset.

    A day exists when it has a quantity record (of any type); with quantity skipped, when it has any
    record. The offset is that of the first quantity record. Every aggregate is a mergeable primitive
    (channels are a 24-bit set), so a day with many records never meets in one task unreduced.
    """
    quantity = F.col("modality") == C.QUANTITY
    days = parts.groupBy("participant_id", "date").agg(
        _first_offset().alias("_offset"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("channel_idx"))).alias("channel_bits"),
        F.bool_or(quantity).alias("has_quantity"),
        F.bool_or(F.col("modality") == C.SLEEP).alias("has_sleep"),
    )
    if not skip_quantity:
        days = days.where("has_quantity")
    return days.select(
        "participant_id",
        "date",
        _unpack_offset(F.col("_offset")).alias("original_time_offset"),
        F.coalesce("channel_bits", F.lit(0)).alias("channel_bits"),
        "has_quantity",
        "has_sleep",
    )


def output_days(parts: DataFrame, skip_quantity: bool = False) -> DataFrame:
    days = parts if skip_quantity else parts.where(F.col("modality") == C.QUANTITY)
    return days.select("participant_id", "date").distinct()


def original_offsets(parts: DataFrame) -> DataFrame:
    return (
        parts.where(F.col("modality") == C.QUANTITY)
        .groupBy("participant_id", "date")
        .agg(_first_offset().alias("_offset"))
        .select("participant_id", "date", _unpack_offset(F.col("_offset")).alias("original_time_offset"))
    )


def fill_is_zero(channel: Column, channel_bits: Column, has_sleep: Column) -> Column:
    """Whether uncovered minutes of a channel are zero (else missing).

    Quantity and workout: zero when the channel has a record that day. Sleep: both rows zero when the
    day has any sleep record. Motion: never.
    """
    first_sleep = C.CHANNEL_INDEX[C.ASLEEP]
    first_motion = C.CHANNEL_INDEX[C.MOTION_ACTIVITIES[0]]
    return (
        F.when(channel >= first_motion, F.lit(False))
        .when(channel >= first_sleep, has_sleep)
        .otherwise(F.getbit(channel_bits, channel) == 1)
    )
