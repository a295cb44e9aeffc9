"""Masked forecast metrics over a long table of predictions.

Rows are cells ``sample_id, channel_idx, <cell key>, y, yhat, mask``. Everything is a mergeable aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions.ranking import bucketed_row_number
from daygrid.operators import days as D

NAN = float("nan")


def _finite(value: Column) -> Column:
    return F.when(
        value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value
    ).otherwise(0.0)


def align(predictions: DataFrame, targets: DataFrame, masks: DataFrame, key: list[str]) -> DataFrame:
    """Cells that predictions, targets and masks have in common."""
    return predictions.join(targets, key).join(masks, key)


def masked_errors(df: DataFrame, finite_guard: bool = True) -> DataFrame:
    """MAE and MSE per channel and overall (``channel_idx`` NULL), weighted by valid cells.

    Non-finite errors count as zero but stay in the denominator; without any valid cell the result is
    NaN.
    """
    sums = df.rollup("channel_idx").agg(*_error_sums(finite_guard))
    return sums.select("channel_idx", *_errors(), F.col("n_valid").alias("n"))


def _error_sums(finite_guard: bool = True) -> list[Column]:
    error = F.col("yhat") - F.col("y")
    absolute, square = F.abs(error), error * error
    if finite_guard:
        absolute, square = _finite(absolute), _finite(square)
    valid = F.col("mask") > 0
    return [F.sum(F.when(valid, absolute)).alias("ae"), F.sum(F.when(valid, square)).alias("se"), F.count_if(valid).alias("n_valid")]


def _errors() -> list[Column]:
    return [F.coalesce(F.try_divide(c, "n_valid"), F.lit(NAN)).alias(name) for c, name in (("ae", "mae"), ("se", "mse"))]


def _pair_moments(x: Column, y: Column) -> list[Column]:
    """Aggregates that ``_correlation`` takes, over rows that have both."""
    return [F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("cxx"), F.var_pop(y).alias("cyy")]


def _correlation(epsilon: float) -> tuple[Column, Column]:
    """Pearson r of a pair from its number of cells and moments, and whether the pair counts."""
    n = F.col("n")
    num, dx, dy = F.col("cxy") * n, F.col("cxx") * n, F.col("cyy") * n
    den = F.sqrt(dx * dy)
    r = F.when(den > epsilon, num / (den + epsilon)).otherwise(0.0)
    return r.alias("r"), ((n >= 2) & (dx > epsilon) & (dy > epsilon)).alias("counted")


def pair_correlations(df: DataFrame, epsilon: float = C.CORRELATION_EPSILON) -> DataFrame:
    """Pearson r per (sample, channel) over valid cells, with whether the pair counts.

    Central moments come from the stable one-pass aggregates, so the series is neither sorted nor kept.
    """
    x, y = F.col("yhat"), F.col("y")
    valid = df.where((F.col("mask") > 0) & x.isNotNull() & y.isNotNull())
    moments = valid.groupBy("sample_id", "channel_idx").agg(F.count("*").alias("n"), *_pair_moments(x, y))
    return moments.select("sample_id", "channel_idx", "n", *_correlation(epsilon))


def mean_correlation(df: DataFrame) -> DataFrame:
    """Plain mean of the counted pairs per channel and overall (``channel_idx`` NULL)."""
    pairs = pair_correlations(df)
    return pairs.rollup("channel_idx").agg(
        F.coalesce(F.avg(F.when(F.col("counted"), F.col("r"))), F.lit(NAN)).alias("pearson"),
        F.count_if("counted").alias("pairs"),
    )


def batch_weighted_errors(
    df: DataFrame, batch_size: int = 16, sample: str = "sample_id", epsilon: float = C.LOSS_EPSILON
) -> DataFrame:
    """MSE, MAE and RMSE as the batch-size-weighted mean of each batch's masked mean.

    Batches are runs of ``batch_size`` samples in digest order, which is the explicit sample sequence.
    """
    error = F.col("yhat") - F.col("y")
    per_sample = df.groupBy(sample).agg(
        F.sum(F.when(F.col("mask") > 0, F.abs(error)).otherwise(0.0)).alias("ae"),
        F.sum(F.when(F.col("mask") > 0, error * error).otherwise(0.0)).alias("se"),
        F.sum("mask").alias("m"),
    )
    numbered = bucketed_row_number(
        per_sample.withColumn("_h", F.md5(F.col(sample).cast("string"))),
        [],
        F.substring("_h", 1, 3),
        [F.col("_h"), F.col(sample)],
        "_seq",
    )
    batches = numbered.groupBy(F.floor((F.col("_seq") - 1) / batch_size).alias("batch_id")).agg(
        F.count("*").alias("samples"),
        (F.sum("ae") / (F.sum("m") + F.lit(epsilon))).alias("mae"),
        (F.sum("se") / (F.sum("m") + F.lit(epsilon))).alias("mse"),
    )
    total = batches.agg(
        F.sum("samples").alias("samples"),
        F.sum(F.col("mae") * F.col("samples")).alias("mae"),
        F.sum(F.col("mse") * F.col("samples")).alias("mse"),
    )
    mse = F.col("mse") / F.col("samples")
    return total.select(
        mse.alias("mse"), (F.col("mae") / F.col("samples")).alias("mae"), F.sqrt(mse).alias("rmse")
    )


def masked_loss(df: DataFrame, epsilon: float = C.LOSS_EPSILON) -> DataFrame:
    error = F.col("yhat") - F.col("y")
    return df.agg(
        (
            F.sum(F.coalesce(error * error, F.lit(0.0)) * F.col("mask")) / (F.sum("mask") + F.lit(epsilon))
        ).alias("loss")
    )


def label_loss(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """MSE over rows with a label."""
    error = F.col(prediction) - F.col(label)
    present = F.col(label).isNotNull() & ~F.isnan(label)
    return df.agg(F.avg(F.when(present, error * error)).alias("loss"))


def report(df: DataFrame, names: DataFrame) -> DataFrame:
    """Channel names and metrics as text.

    Cells are read once: sums and moments of each sample and channel, of which errors and correlations are made. Channels
    without a pair of valid cells are not reported.
    ``names`` has a row per channel; grouped by channel and limited to known ones it is at most 24 rows when broadcast.
    """
    names = names.where(F.col("channel_idx").between(0, C.N_CHANNELS - 1)).groupBy("channel_idx").agg(F.min("channel").alias("channel"))
    both = (F.col("mask") > 0) & F.col("yhat").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(both, F.col("yhat")), F.when(both, F.col("y"))
    pairs = df.groupBy("sample_id", "channel_idx").agg(*_error_sums(), F.count_if(both).alias("n"), *_pair_moments(x, y))
    pairs = pairs.select("channel_idx", "ae", "se", "n_valid", "n", *_correlation(C.CORRELATION_EPSILON))
    sums = pairs.rollup("channel_idx").agg(
        *[F.sum(c).alias(c) for c in ("ae", "se", "n_valid", "n")],
        F.coalesce(F.avg(F.when(F.col("counted"), F.col("r"))), F.lit(NAN)).alias("pearson"),
    )
    # Rows of one channel meet: one each, but for NULL, which stands for the whole and for cells without a channel.
    met = sums.select("channel_idx", *_errors(), "n", "pearson").groupBy("channel_idx").agg(
        F.collect_list(F.struct("mae", "mse")).alias("_e"), F.collect_list(F.when(F.col("n") > 0, F.col("pearson"))).alias("_p")
    )
    metrics = met.select("channel_idx", "_p", F.inline("_e")).select("channel_idx", "mae", "mse", F.explode("_p").alias("pearson"))
    text = [
        F.when(F.isnan(c), F.lit("NaN")).otherwise(F.format_string("%.4f", F.col(c))).alias(c)
        for c in ("mae", "mse", "pearson")
    ]
    named = metrics.join(F.broadcast(names), "channel_idx", "left")
    return named.select(
        F.when(F.col("channel_idx").isNull(), F.lit("Overall"))
        .otherwise(F.coalesce("channel", F.concat(F.lit("Channel "), F.col("channel_idx").cast("string"))))
        .alias("channel"),
        *text,
    )


# --- from windows to metrics --------------------------------------------------------------------------


def last_day_forecast(days: DataFrame) -> DataFrame:
    """Baseline forecast of day rows with roles (``samples.split_days``): the last input day, repeated.

    Returns one row per sample, channel and forecast day with ``forecast``, ``target`` and ``mask`` (that of the target).
    Rows of a sample and channel meet once; an absent last input day gives missing forecasts. Rows that keep their runs meet
    as these, and cells are made of the targets that a reader wants.
    """
    key = ["participant_id", "start_date", "end_date", "channel_idx"]
    inputs, targets = F.col("role") == "x", F.col("role") == "y"
    by_runs = "runs" in days.columns
    day = F.struct(*D.RUN_FORM) if by_runs else F.col("values")
    last = F.max_by(F.when(inputs, day), F.when(inputs, F.col("role_day"))).over(Window.partitionBy(*key)).alias("forecast")
    if by_runs:
        rows = days.select(*key, "role", "role_day", last, *D.RUN_FORM).where(targets)
        forecast = F.when(F.col("forecast").isNotNull(), D.cells(F.col("forecast.zero_fill"), F.col("forecast.runs"))[0])
        target, mask = D.cells("zero_fill", "runs")
        return rows.select(*key, forecast.alias("forecast"), "role_day", target.alias("target"), mask)
    rows = days.select(*key, "role", "role_day", last, F.col("values").alias("target"), "mask")
    return rows.where(targets).select(*key, "forecast", "role_day", "target", "mask")


def forecast_cells(forecast: DataFrame) -> DataFrame:
    """Cells of a forecast: key, minute, y, yhat, mask. One row per minute, aggregated right after."""
    sample = F.concat_ws("_", "participant_id", "start_date").alias("sample_id")
    cells = F.arrays_zip(F.col("target").alias("y"), F.col("forecast").alias("yhat"), F.col("mask").alias("mask"))
    rows = forecast.select(sample, "channel_idx", "role_day", F.posexplode(cells).alias("minute", "_c"))
    return rows.select(
        "sample_id", "channel_idx", "role_day", "minute", F.col("_c.y").cast("double").alias("y"),
        F.col("_c.yhat").cast("double").alias("yhat"), F.col("_c.mask").cast("int").alias("mask"),
    )
