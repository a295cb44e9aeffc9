"""From day-bounded records to per-minute values.

Records are never expanded to seconds. Each covers a second interval ``[s, e)`` of its day with a
constant value; the mean of overlapping records is a running sum over interval edges, and each
constant segment is then spread over the minutes it touches, weighted by the seconds it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import arrays as A
from daygrid.functions import time as T
from daygrid.functions.numbers import holds, nan_to_null
from daygrid.operators.days import DAY, compact, expand, tasks_of

KEY = ["participant_id", "date", "channel_idx"]


def second_intervals(parts: DataFrame) -> DataFrame:
    """Second interval and value of every record part, for all modalities; empty when ``s >= e``.

    Quantity and motion cover whole seconds from their start; a heart-rate reading without duration
    covers one second, other types without duration nothing. Sleep and workout flag every minute they
    touch, so their interval is widened to minute edges and the value is 1.
    """
    start, end = F.col("start_us"), F.col("end_us")
    seconds = T.seconds_between(start, end)
    is_heart_rate = holds(F.col("type") == C.HEART_RATE)
    flag = F.col("modality").isin(C.SLEEP, C.WORKOUT)
    quantity = F.col("modality") == C.QUANTITY
    # A heart-rate reading without duration lasts one second.
    length = F.when(quantity & is_heart_rate & (start == end), F.lit(1)).otherwise(
        T.floor_div(end - start, T.SECOND)
    )
    day_seconds = F.lit(C.SECONDS_PER_DAY)
    return parts.where(F.col("channel_idx").isNotNull()).select(
        *KEY,
        F.when(flag, T.floor_div(T.micros_of_day(start), T.MINUTE) * 60)
        .otherwise(T.second_of_day(start))
        .cast("int")
        .alias("s"),
        F.when(flag, F.least(T.ceil_div(end - T.day_start(start), T.MINUTE) * 60, day_seconds))
        .otherwise(F.least(T.second_of_day(start) + length, day_seconds))
        .cast("int")
        .alias("e"),
        F.when(flag, F.lit(1.0))
        .when(quantity & is_heart_rate, nan_to_null(F.col("value")))
        .when(quantity, F.try_divide(nan_to_null(F.col("value")), seconds))
        .otherwise(nan_to_null(F.col("confidence")))
        .alias("v"),
    )


#: Values are summed as whole multiples of 2^-60, in two longs: multiples of 2^-24 and what is left of them. Sums of
#: longs are exact, so a value that ends leaves nothing behind. A value times its overlap may reach 2^39; beyond that
#: the query fails.
COARSE, FINE = float(1 << 24), float(1 << 36)


def mean_segments(intervals: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Segments ``[sec, sec_end)`` of constant mean over the intervals covering them.

    Edges are summed per second first (map-side, then on the full key), so the running sums see at most
    86,401 rows per day and channel however many records a day has. The channels of a day meet in one task, in as many
    tasks as the session says: merged by their size as edges these would be too few for the minutes made of them.
    """
    scaled = F.col("v") * F.lit(COARSE)
    coarse = F.floor(scaled)
    fine = ((scaled - coarse) * F.lit(FINE)).cast("long")
    valued = intervals.where((F.col("s") < F.col("e")) & F.col("v").isNotNull()).select(
        *key, "s", "e", coarse.alias("coarse"), fine.alias("fine")
    )

    def edge(at: str, sign: int) -> Column:
        parts = [(F.lit(sign) * F.col(c)).alias(f"d_{c}") for c in ("coarse", "fine")]
        return F.struct(F.col(at).alias("sec"), F.lit(sign).alias("dn"), *parts)

    edges = (
        valued.select(*key, F.inline(F.array(edge("s", 1), edge("e", -1))))
        .groupBy(*key, "sec")
        .agg(*[F.sum(c).alias(c) for c in ("dn", "d_coarse", "d_fine")])
        .repartition(tasks_of(intervals), *[c for c in key if c in DAY] or key)
    )
    by_time = Window.partitionBy(*key).orderBy("sec")
    running = by_time.rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("coarse") / F.lit(COARSE) + F.col("fine") / F.lit(COARSE * FINE)
    return (
        edges.withColumn("n", F.sum("dn").over(running))
        .withColumn("coarse", F.sum("d_coarse").over(running))
        .withColumn("fine", F.sum("d_fine").over(running))
        .withColumn("sec_end", F.lead("sec").over(by_time))
        .where("n > 0")
        .select(*key, "sec", "sec_end", (total / F.col("n")).alias("v"))
    )


def minute_stretches(segments: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Mean over the covered seconds of each touched minute, as stretches of ``minutes`` from ``minute`` that have one mean.

    A segment is cut into its whole minutes, which no other touches, and what it covers of its first and last one. These
    pieces, at most three a segment, are what is summed; whole minutes are listed after that, so no table of all minutes is
    held. The input is already partitioned by ``key``, so the aggregation needs no further shuffle.
    """
    sec, end = F.col("sec"), F.col("sec_end")
    first, last = T.floor_div(sec, 60), T.floor_div(end - 1, 60)
    whole, past = T.ceil_div(sec, 60), T.floor_div(end, 60)

    def piece(holds, minute, minutes, covered):
        fields = {"minute": minute, "minutes": minutes, "covered": covered}
        return F.when(holds, F.struct(*[c.cast("int").alias(name) for name, c in fields.items()]))

    pieces = F.array(
        piece(first < whole, first, F.lit(1), F.least(end, whole * 60) - sec),
        piece(whole < past, whole, past - whole, F.lit(60)),
        piece((past <= last) & (whole <= last), last, F.lit(1), end - last * 60),
    )
    return (
        segments.select(*key, "v", F.inline(pieces))
        .where("minute IS NOT NULL")
        .groupBy(*key, "minute", "minutes")
        .agg(
            (F.sum(F.col("v") * F.col("covered")) / F.sum("covered")).alias("value"),
            F.sum("covered").cast("int").alias("covered_seconds"),
        )
    )


def every_minute(stretches: DataFrame) -> DataFrame:
    """A row per minute of each stretch; one with a NULL minute where there is no stretch. Row-local."""
    minutes = F.explode_outer(F.sequence(F.col("minute"), F.col("minute") + F.col("minutes") - 1))
    return stretches.withColumn("minute", minutes).drop("minutes")


def minute_means(segments: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Mean over the covered seconds of each touched minute: ``key, minute, value, covered_seconds``."""
    return every_minute(minute_stretches(segments, key))


def value_stretches(parts: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Sparse values of all channels as stretches: ``participant_id, date, channel_idx, minute, minutes, value``.

    With ``days`` only of these; others are left out while they are segments.
    """
    segments = mean_segments(second_intervals(parts))
    if days is not None:
        segments = segments.join(days, DAY, "left_semi")
    return minute_stretches(segments).drop("covered_seconds")


def minute_values(parts: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """The same, a row per minute: ``participant_id, date, channel_idx, minute, value``."""
    return every_minute(value_stretches(parts, days))


def day_channel(minutes: DataFrame, days: DataFrame) -> DataFrame:
    """Dense rows: one per participant, day and channel with 1440 values and their mask."""
    return expand(compact(minutes, days))


def observation_mask(values: Column) -> Column:
    return A.mapped(
        values, lambda v: F.when(A.observed(v), F.lit(1)).otherwise(F.lit(0)).cast("tinyint")
    )


def modality_channels(modality: str) -> list[int]:
    names = {
        C.QUANTITY: C.QUANTITY_TYPES,
        C.WORKOUT: C.WORKOUT_TYPES,
        C.SLEEP: C.SLEEP_CATEGORIES,
        C.MOTION: C.MOTION_ACTIVITIES,
    }[modality]
    return [C.CHANNEL_INDEX[n] for n in names]


def modality_grid(parts: DataFrame, modality: str) -> DataFrame:
    """Per-minute values of one modality with its fill rule, in sparse form.

    Adds one row with a NULL minute for each channel that has records but covers no minute, so an empty
    channel stays distinguishable from an absent one. Channels meet their values while these are stretches.
    """
    own = parts.where(F.col("modality") == modality)
    values = minute_stretches(mean_segments(second_intervals(own)))
    present = own.where(F.col("channel_idx").isNotNull()).select(*KEY).distinct()
    return every_minute(present.join(values, KEY, "left")).drop("covered_seconds")
