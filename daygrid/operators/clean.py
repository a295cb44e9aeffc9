"""Record cleaning: units, plausibility, local time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import time as T
from daygrid.functions.numbers import holds, nan_to_null, rate

# --------------------------------------------------------------------------------------------------
# units


def normalise_units(df: DataFrame) -> DataFrame:
    """Length to m, mass to kg, speed to m/s, volume to L; other units stay as they are.

    In a union table only quantity records are converted.
    """
    factors = _literal_map({u: F.lit(f) for u, (_, f) in C.UNIT_FACTORS.items()})
    targets = _literal_map({u: F.lit(t) for u, (t, _) in C.UNIT_FACTORS.items()})
    unit = F.col("unit")
    if "modality" in df.columns:
        unit = F.when(F.col("modality") == C.QUANTITY, unit)
    return df.withColumns(
        {
            "value": F.col("value") * F.coalesce(factors[unit], F.lit(1.0)),
            "unit": F.coalesce(targets[unit], F.col("unit")),
        }
    )


def _literal_map(entries: dict[str, Column]) -> Column:
    """A constant map; Catalyst folds it, which keeps lookups small in generated code."""
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])


# --------------------------------------------------------------------------------------------------
# plausibility predicates (columns); a missing column is a different case from a NULL value


def _duration() -> Column:
    return T.whole_seconds_between(F.col("start_us"), F.col("end_us"))


def same_offset(columns: list[str]) -> Column:
    if "end_offset" not in columns:
        return F.lit(True)
    return holds(F.col("start_offset") == F.col("end_offset"))


def not_negative(columns: list[str]) -> Column:
    if "end_us" not in columns:
        return F.lit(True)
    return holds(F.col("end_us") >= F.col("start_us"))


def not_too_long(columns: list[str]) -> Column:
    """Duration of at most 24 hours on the times as recorded, before any shift."""
    if "end_us" not in columns:
        return F.lit(True)
    return holds((F.col("end_us") - F.col("start_us")) <= F.lit(C.MAX_DURATION_HOURS * T.HOUR))


def _value() -> Column:
    return nan_to_null(F.col("value"))


def _rate_at_most(limit: float) -> Column:
    return holds((_value() >= 0) & (rate(_value(), _duration()) <= F.lit(float(limit))))


def plausible_steps(columns: list[str]) -> Column:
    return _rate_at_most(C.MAX_STEPS_PER_SECOND)


def plausible_energy(columns: list[str]) -> Column:
    """Needs a positive duration; without time columns no energy record passes."""
    if "end_us" not in columns or "start_us" not in columns:
        return F.lit(False)
    return holds(_duration() > 0) & _rate_at_most(C.MAX_ENERGY_PER_SECOND)


def plausible_walking_running(columns: list[str]) -> Column:
    return _rate_at_most(C.MAX_WALKING_RUNNING_METRES_PER_SECOND)


def plausible_cycling(columns: list[str]) -> Column:
    if "end_us" not in columns:
        return holds(_value() >= 0)
    return _rate_at_most(C.MAX_CYCLING_METRES_PER_SECOND)


def plausible_stand_time(columns: list[str], compat: bool = True) -> Column:
    """Stand time in minutes. ``compat`` keeps the published rule, which caps the total at one second;
    without it only the rate is capped."""
    if "end_us" not in columns:
        return holds((_value() >= 0) & (_value() <= F.lit(float(C.MAX_STAND_RATE))))
    seconds = _value() * 60
    capped = (seconds <= F.lit(float(C.MAX_STAND_SECONDS))) if compat else F.lit(True)
    return holds(
        (seconds >= 0) & capped & (rate(seconds, _duration()) <= F.lit(float(C.MAX_STAND_RATE)))
    )


def plausible_heart_rate(columns: list[str]) -> Column:
    return holds(
        _value().between(F.lit(C.MIN_HEART_RATE_PER_SECOND), F.lit(C.MAX_HEART_RATE_PER_SECOND))
    )


TYPE_RULES = {
    C.STEP_COUNT: plausible_steps,
    C.ACTIVE_ENERGY: plausible_energy,
    C.DISTANCE_WALKING_RUNNING: plausible_walking_running,
    C.DISTANCE_CYCLING: plausible_cycling,
    C.STAND_TIME: plausible_stand_time,
    C.HEART_RATE: plausible_heart_rate,
}

# Rules by modality. Motion has no end offset and is exempt from the offset rule.
MODALITY_RULES = {
    C.QUANTITY: [same_offset, not_negative, not_too_long],
    C.WORKOUT: [same_offset, not_negative, not_too_long],
    C.SLEEP: [same_offset, not_negative, not_too_long],
    C.MOTION: [not_negative, not_too_long],
}


def keep_plausible_type(df: DataFrame, record_type: str, **options) -> DataFrame:
    """Apply the rule of one quantity type; other records pass unchanged."""
    rule = TYPE_RULES[record_type](df.columns, **options)
    return df.where(~holds(F.col("type") == record_type) | rule)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


RATE_LIMITS = {
    C.STEP_COUNT: C.MAX_STEPS_PER_SECOND,
    C.ACTIVE_ENERGY: C.MAX_ENERGY_PER_SECOND,
    C.DISTANCE_WALKING_RUNNING: C.MAX_WALKING_RUNNING_METRES_PER_SECOND,
    C.DISTANCE_CYCLING: C.MAX_CYCLING_METRES_PER_SECOND,
    C.STAND_TIME: C.MAX_STAND_RATE,
}


def type_rules(columns: list[str]) -> Column:
    """All six type rules at once: the same decisions as the single rules, with one rate test."""
    if "end_us" not in columns or "start_us" not in columns:
        return _all([~holds(F.col("type") == t) | rule(columns) for t, rule in TYPE_RULES.items()])
    limits = _literal_map({t: F.lit(float(v)) for t, v in RATE_LIMITS.items()})
    amount = _value() * F.when(F.col("type") == C.STAND_TIME, 60).otherwise(1)
    total_cap = F.when(F.col("type") == C.STAND_TIME, float(C.MAX_STAND_SECONDS)).otherwise(
        float("inf")
    )
    rated = holds(
        (amount >= 0) & (amount <= total_cap) & (rate(amount, _duration()) <= limits[F.col("type")])
    )
    positive = ~holds(F.col("type") == C.ACTIVE_ENERGY) | holds(_duration() > 0)
    return (
        F.when(F.col("type").isin(*RATE_LIMITS), rated & positive)
        .when(F.col("type") == C.HEART_RATE, plausible_heart_rate(columns))
        .otherwise(F.lit(True))
    )


def plausible(columns: list[str]) -> Column:
    """The whole rule set for a union table as one predicate."""
    return (
        not_negative(columns)
        & not_too_long(columns)
        & ((F.col("modality") == C.MOTION) | same_offset(columns))
        & ((F.col("modality") != C.QUANTITY) | type_rules(columns))
    )


def keep_plausible(df: DataFrame, modality: str | None = None) -> DataFrame:
    """Filter a union table, or a table of one modality when ``modality`` is given."""
    if modality is None:
        return df.where(plausible(df.columns))
    condition = _all([r(df.columns) for r in MODALITY_RULES[modality]])
    if modality == C.QUANTITY:
        condition = condition & type_rules(df.columns)
    return df.where(condition)


# --------------------------------------------------------------------------------------------------
# local time


def _shift(us: Column, offset: Column) -> Column:
    return us + F.coalesce(offset, F.lit(0)).cast("long") * F.lit(T.MINUTE)


def to_local_time(df: DataFrame) -> DataFrame:
    """Shift a union table to local time.

    Quantity and workout ends use the end offset, motion ends the start offset; a workout without an
    end ends at its start. Sleep ends are set from the duration when the record is split.
    """
    start = _shift(F.col("start_us"), F.col("start_offset"))
    end = (
        F.when(F.col("modality") == C.MOTION, _shift(F.col("end_us"), F.col("start_offset")))
        .when(F.col("modality") == C.SLEEP, F.col("end_us"))
        .when(
            (F.col("modality") == C.WORKOUT) & F.col("end_us").isNull(),
            start,
        )
        .otherwise(_shift(F.col("end_us"), F.col("end_offset")))
    )
    return df.withColumns({"start_us": start, "end_us": end})


def to_local_time_generic(df: DataFrame) -> DataFrame:
    """Shift the start by its offset and the end by its own offset when there is one."""
    end_offset = "end_offset" if "end_offset" in df.columns else "start_offset"
    changes = {"start_us": _shift(F.col("start_us"), F.col("start_offset"))}
    if "end_us" in df.columns:
        changes["end_us"] = _shift(F.col("end_us"), F.col(end_offset))
    return df.withColumns(changes)


def sleep_end_from_duration(df: DataFrame) -> DataFrame:
    """End of a sleep record = start + value seconds, replacing any recorded end."""
    end = F.col("start_us") + T.seconds_to_micros(nan_to_null(F.col("value")))
    if "modality" in df.columns:
        end = F.when(F.col("modality") == C.SLEEP, end).otherwise(F.col("end_us"))
    return df.withColumn("end_us", end)


def without_modalities(df: DataFrame, skip: list[str]) -> DataFrame:
    return df.where(~F.col("modality").isin(*skip)) if skip else df


# --------------------------------------------------------------------------------------------------
# report helpers


def with_default_categories(df: DataFrame) -> DataFrame:
    """Unknown workouts become Other, unknown motion becomes not available."""
    workout = F.when(F.col("workout_type").isin(*C.WORKOUT_TYPES), F.col("workout_type")).otherwise(
        C.WORKOUT_DEFAULT
    )
    motion = F.when(F.col("activity").isin(*C.MOTION_ACTIVITIES), F.col("activity")).otherwise(
        C.MOTION_DEFAULT
    )
    return df.withColumns(
        {
            "workout_type": F.when(F.col("modality") == C.WORKOUT, workout),
            "activity": F.when(F.col("modality") == C.MOTION, motion),
        }
    )


def report_units(df: DataFrame) -> DataFrame:
    """Heart rate in beats per minute, stand time in seconds; seconds since local midnight."""
    return df.withColumns(
        {
            "value": F.when(
                F.col("type").isin(C.HEART_RATE, C.STAND_TIME), F.col("value") * 60
            ).otherwise(F.col("value")),
            "second_of_day": T.second_of_day(F.col("start_us")),
        }
    )


def clipped_rates(df: DataFrame) -> DataFrame:
    """value / duration per record, clipped to the report limits; zero durations are dropped.

    Records of types without limits are dropped. Expects values in report units.
    """
    duration = T.seconds_between(F.col("start_us"), F.col("end_us"))
    low = high = F.lit(None).cast("double")
    for record_type, (lo, hi) in C.RATE_REPORT_LIMITS.items():
        match = F.col("type") == record_type
        low = F.when(match, F.lit(float(lo))).otherwise(low)
        high = F.when(match, F.lit(float(hi))).otherwise(high)
    return (
        df.where(F.col("type").isin(*C.RATE_REPORT_LIMITS))
        .withColumn("duration", duration)
        .where(F.col("duration") != 0)
        .withColumn(
            "rate", F.least(F.greatest(rate(F.col("value"), F.col("duration")), low), high)
        )
    )
