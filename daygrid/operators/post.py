"""Mask rules, gap filling and scaling of sample rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import arrays as A
from daygrid.operators.days import with_run_values
from daygrid.operators.samples import SAMPLE

HEART_RATE_CHANNEL = C.CHANNEL_INDEX[C.HEART_RATE]


def masked_flags(mask: Column) -> Column:
    return F.transform(mask, lambda m: m == 0)


def masked_runs(mask: Column, minimum: int) -> Column:
    """Runs of at least ``minimum`` masked cells, as [start, end)."""
    n, first = F.size(mask), F.get(mask, F.lit(0))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    found = A.runs(masked_flags(mask), minimum)
    alike = F.filter(whole, lambda r: (first == 0) & (r["end"] >= minimum))
    return F.when(A.is_constant(mask), alike).otherwise(found)


def fully_masked(mask: Column) -> Column:
    """Whether no cell is observed."""
    return F.when(A.is_constant(mask), F.get(mask, F.lit(0)) == 0).otherwise(~F.exists(mask, lambda m: m != 0))


def all_channels_masked(samples: DataFrame, minimum: int = C.ALL_CHANNELS_MASKED_MINUTES) -> DataFrame:
    """Stretches of a day where every channel is masked for at least ``minimum`` minutes.

    Each mask becomes the list of its observed stretches; only these meet, at most 24 lists per sample and day.
    """
    mask = F.col("mask")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size(mask).alias("end")))
    alike = F.filter(whole, lambda r: F.get(mask, F.lit(0)) > 0)
    seen = F.when(A.is_constant(mask), alike).otherwise(A.runs(F.transform(mask, lambda m: m > 0), 1))
    rows = samples.select(*SAMPLE, "day_index", seen.alias("_seen"), F.size(mask).alias("_n"))
    days = rows.groupBy(*SAMPLE, "day_index").agg(
        F.array_sort(F.flatten(F.collect_list("_seen"))).alias("_seen"), F.max("_n").alias("_n")
    )
    end = F.struct(F.col("_n").alias("start"), F.col("_n").alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, run):
        gap = F.array(F.struct(acc["reach"].alias("start"), run["start"].alias("end")))
        long = run["start"] - acc["reach"] >= minimum
        return F.struct(
            F.greatest(acc["reach"], run["end"]).alias("reach"),
            F.when(long, F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"),
        )

    start = F.struct(F.lit(0).alias("reach"), none.alias("gaps"))
    gaps = F.aggregate(F.concat("_seen", F.array(end)), start, step, lambda acc: acc["gaps"])
    return days.select(*SAMPLE, "day_index", F.inline(gaps)).withColumnsRenamed({"start": "start_minute", "end": "end_minute"})


def mask_channels_with_empty_day(samples: DataFrame) -> DataFrame:
    """A channel fully masked on any day of the window is masked on all its days."""
    empty_day = fully_masked(F.col("mask"))
    over_days = Window.partitionBy(*SAMPLE, "channel_idx")
    return (
        samples.withColumn("_empty", F.bool_or(empty_day).over(over_days))
        .withColumn(
            "mask",
            F.when(F.col("_empty"), F.array_repeat(F.lit(0).cast("tinyint"), F.size("mask"))).otherwise(
                F.col("mask")
            ),
        )
        .drop("_empty")
    )


def heart_rate_masked_runs(
    samples: DataFrame,
    minimum: int = C.HEART_RATE_GAP_MINUTES,
    indices: list[int] | None = None,
    after_blanking: bool = True,
) -> DataFrame:
    """Long masked stretches of the heart-rate channel. ``indices`` are the selected channels, if any.

    With ``after_blanking`` the rules are a sequence: a sample whose heart-rate channel the rule for empty days has blanked
    is past this one and lists nothing. Without, all samples are judged.
    """
    if indices is not None and HEART_RATE_CHANNEL not in indices:
        return heart_rate_masked_runs(samples.where(F.lit(False)), minimum)
    over_days = Window.partitionBy(*SAMPLE, "channel_idx")
    return (
        samples.where(F.col("channel_idx") == HEART_RATE_CHANNEL)
        .withColumn("_blank", F.bool_or(fully_masked(F.col("mask"))).over(over_days))
        .where(~F.col("_blank") | F.lit(not after_blanking))
        .select(*SAMPLE, "day_index", F.inline(masked_runs(F.col("mask"), minimum)))
        .withColumnsRenamed({"start": "start_minute", "end": "end_minute"})
    )


def custom_mask(samples: DataFrame) -> DataFrame:
    """The three mask rules together. The stretch rules only touch cells that are masked already, so the
    result differs from the input by the empty-day rule alone; data is zeroed where masked."""
    return masked_product(mask_channels_with_empty_day(samples))


def strip_nans(df: DataFrame, replacement: float = 0.0) -> DataFrame:
    return df.withColumns(
        {
            "values": F.transform("values", lambda v: A.nan_to(v, replacement)),
            "mask": F.transform("mask", lambda m: F.coalesce(m, F.lit(replacement).cast("tinyint"))),
        }
    )


def masked_product(df: DataFrame) -> DataFrame:
    """Zero where masked."""
    return df.withColumns(
        {
            "values": A.zipped("values", "mask", lambda v, m: F.when(m == 0, F.lit(0.0)).otherwise(v)),
            **with_run_values(df, lambda v: F.when(A.observed(v), v).otherwise(F.lit(0.0))),
        }
    )


def masked_to_nan(values: Column, mask: Column) -> Column:
    """Missing where masked."""
    return A.zipped(
        values, mask, lambda v, m: F.when(m == 0, F.lit(float("nan"))).otherwise(v)
    )


def fill_gaps(
    values: Column, mask: Column, threshold: int = C.HEART_RATE_GAP_MINUTES, method: str = "linear"
) -> Column:
    """Fill short gaps of one day; returns a struct of the new values and mask.

    A gap is a run of zeros with mask 1. It is masked when it reaches ``threshold``, touches either end of
    the day or has no valid point on any side. With one valid side the value is carried; with both it is
    interpolated between the nearest valid points, which may lie beyond masked cells. A day without a gap
    stays as it is; in a day with one, masked cells become zero. Row-local.
    """

    def describe(values, mask, gaps):
        valid = F.filter(
            A.positions(F.size(values)),
            lambda i: F.coalesce((F.get(mask, i) > 0.5) & (F.get(values, i) != 0), F.lit(False)),
        )

        def neighbours(valid):
            # Gaps and valid points in one sorted list: the place of the n-th gap, less n, counts the points before it.
            both = F.array_sort(
                F.concat(
                    F.transform(valid, lambda i: F.struct(i.cast("int").alias("at"), F.lit(0).alias("kind"))),
                    F.transform(gaps, lambda g: F.struct(g["start"].cast("int").alias("at"), F.lit(1).alias("kind"))),
                )
            )
            placed = F.transform(both, lambda x, j: F.struct(x["kind"].alias("kind"), j.alias("j")))
            return A.let(
                F.transform(F.filter(placed, lambda x: x["kind"] == 1), lambda x: x["j"]),
                lambda places: F.transform(
                    gaps,
                    lambda g, n: F.struct(
                        g["start"].alias("start"),
                        g["end"].alias("end"),
                        F.get(valid, F.get(places, n) - n - 1).alias("before"),
                        F.get(valid, F.get(places, n) - n).alias("after"),
                    ),
                ),
            )

        return A.let(valid, neighbours)

    def fill(values, mask, gaps):
        n = F.size(values)

        def give_up(g):
            return (
                ((g["end"] - g["start"]) >= threshold)
                | (g["start"] == 0)
                | (g["end"] == n)
                | (g["before"].isNull() & g["after"].isNull())
            )

        def cell(g, i):
            before, after = F.get(values, g["before"]), F.get(values, g["after"])
            if method == "nearest":
                inside = F.when((i - g["before"]) <= (g["after"] - i), before).otherwise(after)
            else:
                weight = (i - g["before"]) / (g["after"] - g["before"])
                inside = before * (1 - weight) + after * weight
            return F.when(g["before"].isNull(), after).when(g["after"].isNull(), before).otherwise(inside)

        def new_values(g):
            return F.when(
                give_up(g), F.array_repeat(F.lit(0.0), g["end"] - g["start"])
            ).otherwise(F.transform(F.sequence(g["start"], g["end"] - 1), lambda i: cell(g, i)))

        def new_mask(g):
            return F.array_repeat(F.when(give_up(g), F.lit(0)).otherwise(F.lit(1)), g["end"] - g["start"])

        return A.let(
            A.replace_runs(mask, gaps, new_mask),
            lambda m: F.struct(
                F.zip_with(
                    A.replace_runs(values, gaps, new_values),
                    m,
                    lambda x, keep: F.when(keep > 0.5, x).otherwise(F.lit(0.0)),
                ).alias("values"),
                m.alias("mask"),
            ),
        )

    def run(values, mask):
        zero_and_open = F.zip_with(
            values, mask, lambda x, keep: F.coalesce((x == 0) & (keep > 0.5), F.lit(False))
        )
        return A.let(
            A.runs(zero_and_open, 1),
            lambda gaps: F.when(
                F.size(gaps) == 0, F.struct(values.alias("values"), mask.alias("mask"))
            ).otherwise(A.let(describe(values, mask, gaps), lambda g: fill(values, mask, g))),
        )

    return A.let(
        F.transform(values, lambda x: x.cast("double")),
        lambda v: A.let(F.transform(mask, lambda m: m.cast("int")), lambda m: run(v, m)),
    )


def fill_heart_rate(
    df: DataFrame,
    threshold: int = C.HEART_RATE_GAP_MINUTES,
    method: str = "linear",
    only_channel: int | None = None,
) -> DataFrame:
    """Gap filling on day rows; with ``only_channel`` the other channels pass unchanged."""
    unchanged = F.struct(
        F.transform("values", lambda x: x.cast("double")).alias("values"),
        F.transform("mask", lambda m: m.cast("int")).alias("mask"),
    )
    filled = fill_gaps(F.col("values"), F.col("mask"), threshold, method)
    if only_channel is not None:
        filled = F.when(F.col("channel_idx") == only_channel, filled).otherwise(unchanged)
    others = [c for c in df.columns if c not in ("values", "mask")]
    return df.select(*others, F.inline(F.array(filled)))


def standardise(df: DataFrame, params: DataFrame, epsilon: float = C.STD_EPSILON) -> DataFrame:
    """(v - mean) / std per channel; channels with almost no spread stay as they are.

    ``params`` has one row per channel; they are grouped by channel, so the broadcast has 24 rows at most, and a channel
    given twice is an error.
    """
    twice = F.raise_error(F.lit("standardization parameters given more than once for a channel"))
    small = F.broadcast(
        params.where(F.col("feature_index").between(0, C.N_CHANNELS - 1))
        .groupBy(F.col("feature_index").alias("channel_idx"))
        .agg(F.when(F.count("*") > 1, twice).otherwise(F.max("mean")).alias("mean"), F.max("std_dev").alias("std_dev"))
    )
    usable = F.abs("std_dev") >= epsilon
    return (
        df.join(small, "channel_idx", "left")
        .withColumn(
            "values",
            F.when(
                usable,
                A.mapped("values", lambda v: (v - F.col("mean")) / F.col("std_dev")),
            ).otherwise(A.mapped("values", lambda v: v.cast("double"))),
        )
        .drop("mean", "std_dev")
    )


def instance_normalise(
    df: DataFrame,
    column: str = "values",
    eps: float = C.REVIN_EPSILON,
    subtract_last: bool = False,
    affine: tuple[float, float] | None = None,
    skip_flat: bool = False,
) -> DataFrame:
    """Reversible normalisation of a series held in an array, one row per sample and channel. Row-local.

    The array is replaced by its normal form, and ``inverse`` (a factor and an offset) travels with the row:
    ``instance_denormalise`` applies it to any array in the normal form, a forecast for example. With ``skip_flat``
    series whose sample deviation is below eps stay as they are and their inverse changes nothing.
    """
    add = lambda a, v: a + v

    def normal(x):
        n = F.size(x)
        mean = F.try_divide(F.aggregate(x, F.lit(0.0), add), n)

        def with_mean(mean):
            squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
            return A.let(F.struct(mean.alias("mean"), squares.alias("squares")), with_moments)

        def with_moments(m):
            scale = F.sqrt(F.try_divide(m["squares"], n) + F.lit(eps))
            center = F.get(x, n - 1) if subtract_last else m["mean"]
            weight, bias = affine or (1.0, 0.0)
            # x = ((normal - bias) / (weight + eps^2)) * scale + center, as published.
            shrunk = F.lit(weight + eps * eps if affine else 1.0)
            flat = (F.sqrt(F.try_divide(m["squares"], n - 1)) < eps) if skip_flat else F.lit(False)
            flat = F.coalesce(flat, F.lit(False))
            forth = F.struct(
                F.when(flat, F.lit(0.0)).otherwise(center).alias("center"),
                F.when(flat, F.lit(1.0)).otherwise(scale).alias("scale"),
                F.when(flat, F.lit(1.0)).otherwise(F.lit(weight)).alias("weight"),
                F.when(flat, F.lit(0.0)).otherwise(F.lit(bias)).alias("bias"),
                F.when(flat, F.lit(1.0)).otherwise(shrunk).alias("shrunk"),
            )
            return A.let(forth, applied)

        def applied(f):
            back = F.struct(
                (f["scale"] / f["shrunk"]).alias("factor"),
                (f["center"] - f["bias"] * f["scale"] / f["shrunk"]).alias("offset"),
            )
            new = F.transform(x, lambda v: (v - f["center"]) / f["scale"] * f["weight"] + f["bias"])
            return F.struct(new.alias("values"), back.alias("inverse"))

        return A.let(mean, with_mean)

    found = A.let(F.transform(column, lambda v: v.cast("double")), normal)
    others = [c for c in df.columns if c != column]
    return df.select(*others, found.alias("_n")).select(*others, F.col("_n.values").alias(column), F.col("_n.inverse").alias("inverse"))


def instance_denormalise(df: DataFrame, column: str = "values", into: str | None = None) -> DataFrame:
    """Undo ``instance_normalise`` on an array, with the ``inverse`` of its row. Row-local."""
    back = F.transform(column, lambda v: v * F.col("inverse.factor") + F.col("inverse.offset"))
    return df.withColumn(into or column, back)


def apply_all(df: DataFrame, transforms: list) -> DataFrame:
    """Apply user-supplied DataFrame transforms in order."""
    return reduce(lambda d, f: d.transform(f), transforms, df)


def apply_to_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """Escape hatch for a Python function over Arrow batches of sample rows."""
    return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)
