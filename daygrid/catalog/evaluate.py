"""Forecast evaluation (inventory section E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.catalog.registry import query, rounded_all
from daygrid import constants as C
from daygrid.catalog.sql import _list, rd
from daygrid.operators import evaluate, samples
from daygrid.plans import stages
from daygrid.sources import adapter

#: Some predictions are NaN, some infinite: with the guard they count as no error, without it they show.
ODD = """(SELECT * REPLACE (CASE WHEN sample_id % 11 = 3 AND hour = 5 AND channel_idx = 1 THEN 'NaN'::DOUBLE
  WHEN sample_id % 13 = 4 AND hour = 7 AND channel_idx = 2 THEN 'Infinity'::DOUBLE ELSE yhat END AS yhat) FROM pred)"""


def _odd(spark, d):
    s, hour, channel = F.col("sample_id"), F.col("hour"), F.col("channel_idx")
    odd = F.when((s % 11 == 3) & (hour == 5) & (channel == 1), F.lit(float("nan")))
    odd = odd.when((s % 13 == 4) & (hour == 7) & (channel == 2), F.lit(float("inf")))
    return adapter.predictions(spark, d).withColumn("yhat", odd.otherwise(F.col("yhat")))


GUARDED_SQL = f"""SELECT channel_idx, {rd('sum(CASE WHEN mask = 1 AND isfinite(yhat - y) THEN abs(yhat - y) ELSE 0 END) / count(*) FILTER (mask = 1)')} AS mae,
{rd('sum(CASE WHEN mask = 1 AND isfinite(yhat - y) THEN (yhat - y) ** 2 ELSE 0 END) / count(*) FILTER (mask = 1)', 4)} AS mse,
count(*) FILTER (mask = 1) AS n FROM {ODD} GROUP BY ROLLUP (channel_idx)"""
ERRORS_SQL = f"""SELECT channel_idx, {rd('sum(CASE WHEN mask = 1 THEN coalesce(abs(yhat - y), 0) END) / count(*) FILTER (mask = 1)')} AS mae,
{rd('sum(CASE WHEN mask = 1 THEN coalesce((yhat - y) ** 2, 0) END) / count(*) FILTER (mask = 1)', 4)} AS mse,
count(*) FILTER (mask = 1) AS n FROM pred GROUP BY ROLLUP (channel_idx)"""


def _errors(df):
    from daygrid.catalog.registry import rounded

    return df.select("channel_idx", rounded("mae").alias("mae"), rounded("mse", 4).alias("mse"), "n")


@query("e01_masked_errors", GUARDED_SQL)
def _(spark, d):
    return _errors(evaluate.masked_errors(_odd(spark, d)))


PAIRS = """(SELECT sample_id, channel_idx, count(*) AS n, covar_pop(yhat, y) * count(*) AS num,
 var_pop(yhat) * count(*) AS dx, var_pop(y) * count(*) AS dy
FROM pred WHERE mask = 1 AND yhat IS NOT NULL AND y IS NOT NULL GROUP BY ALL)"""
R = "CASE WHEN sqrt(dx * dy) > 1e-9 THEN num / (sqrt(dx * dy) + 1e-9) ELSE 0 END"
COUNTED = "n >= 2 AND dx > 1e-9 AND dy > 1e-9"


@query(
    "e02_mean_correlation",
    f"""SELECT channel_idx, {rd(f'avg(CASE WHEN {COUNTED} THEN {R} END)')} AS pearson,
count(*) FILTER ({COUNTED}) AS pairs FROM {PAIRS} GROUP BY ROLLUP (channel_idx)""",
)
def _(spark, d):
    return rounded_all(evaluate.mean_correlation(adapter.predictions(spark, d)))


@query(
    "e02b_pair_correlations",
    f"SELECT sample_id, channel_idx, n, {rd(R)} AS r, {COUNTED} AS counted FROM {PAIRS}",
)
def _(spark, d):
    return rounded_all(evaluate.pair_correlations(adapter.predictions(spark, d)))


@query(
    "e03_batch_weighted_errors",
    f"""SELECT {rd('sum(mse * k) / sum(k)', 4)} AS mse, {rd('sum(mae * k) / sum(k)', 4)} AS mae, {rd('sqrt(sum(mse * k) / sum(k))', 4)} AS rmse
FROM (SELECT count(*) AS k, sum(ae) / (sum(m) + 1e-10) AS mae, sum(se) / (sum(m) + 1e-10) AS mse FROM (
  SELECT sample_id, sum(CASE WHEN mask = 1 THEN coalesce(abs(yhat - y), 0) ELSE 0 END) AS ae,
    sum(CASE WHEN mask = 1 THEN coalesce((yhat - y) ** 2, 0) ELSE 0 END) AS se, sum(mask) AS m,
    (row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) - 1) // 16 AS batch
  FROM pred GROUP BY sample_id) GROUP BY batch)""",
)
def _(spark, d):
    return rounded_all(evaluate.batch_weighted_errors(adapter.predictions(spark, d)), 4)


@query("e04_flat_masked_errors", ERRORS_SQL.replace("FROM pred", f"FROM {ODD}"))
def _(spark, d):
    return _errors(evaluate.masked_errors(_odd(spark, d), finite_guard=False))


@query(
    "e05_masked_loss",
    f"""SELECT 'sequence' AS part, {rd('sum(coalesce((yhat - y) ** 2, 0) * mask) / (sum(mask) + 1e-10)', 4)} AS loss FROM pred
UNION ALL SELECT 'label', {rd('avg((yhat - y) ** 2) FILTER (hour % 3 <> 0)', 4)} FROM pred""",
)
def _(spark, d):
    df = adapter.predictions(spark, d)
    labelled = df.withColumn("label", F.when(F.col("hour") % 3 != 0, F.col("y")))
    return rounded_all(
        evaluate.masked_loss(df)
        .withColumn("part", F.lit("sequence"))
        .unionByName(evaluate.label_loss(labelled, "yhat", "label").withColumn("part", F.lit("label"))),
        4,
    )


@query(
    "e06_aligned_cells",
    f"""SELECT sample_id, channel_idx, day_index, hour, {rd('y', 2)} AS y, {rd('yhat', 2)} AS yhat, mask FROM pred
WHERE yhat IS NOT NULL AND hour <> 23 AND day_index < 28""",
)
def _(spark, d):
    key = ["sample_id", "channel_idx", "day_index", "hour"]
    df = adapter.predictions(spark, d)
    predicted = df.where(F.col("yhat").isNotNull()).select(*key, "yhat")
    target = df.where(F.col("hour") != 23).select(*key, "y")
    mask = df.where(F.col("day_index") < 28).select(*key, "mask")
    return rounded_all(evaluate.align(predicted, target, mask, key), 2)


@query(
    "e07_report",
    f"""SELECT coalesce(CASE WHEN e.channel_idx = 4 THEN 'Channel 4' ELSE ['click', 'error', 'purchase', 'signup'][e.channel_idx + 1] END, 'Overall') AS channel,
  format('{{:.4f}}', e.mae) AS mae, format('{{:.4f}}', e.mse) AS mse, format('{{:.4f}}', p.pearson) AS pearson
FROM ({ERRORS_SQL}) e JOIN (SELECT channel_idx, avg(CASE WHEN {COUNTED} THEN {R} END) AS pearson FROM {PAIRS}
  GROUP BY ROLLUP (channel_idx)) p ON p.channel_idx IS NOT DISTINCT FROM e.channel_idx""",
)
def _(spark, d):
    names = spark.createDataFrame(
        [(0, "click"), (1, "error"), (2, "purchase"), (3, "signup")], "channel_idx int, channel string"
    )
    return evaluate.report(adapter.predictions(spark, d), names)


# Windows of seven days, five of input: the fifth day is the forecast of the last two.
FORECAST_SQL = """(SELECT t.*, p.value AS yhat FROM (
  SELECT w.participant_id || '_' || w.start_date AS sample_id, w.participant_id, w.start_date, CAST(m.channel_idx AS INTEGER) AS channel_idx, m.minute,
    CAST(CAST(m.value AS FLOAT) AS DOUBLE) AS y
  FROM win w JOIN wmin m ON m.participant_id = w.participant_id AND m.start_date = w.start_date WHERE m.day_index >= 5 AND m.value <> 0) t
LEFT JOIN (SELECT participant_id, start_date, channel_idx, minute, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM wmin WHERE day_index = 4) p
  ON p.participant_id = t.participant_id AND p.start_date = t.start_date AND p.channel_idx = t.channel_idx AND p.minute = t.minute)"""


@query(
    "e08_report_from_records",
    f"""SELECT coalesce({_list(C.CHANNELS)}[e.channel_idx + 1], 'Overall') AS channel, format('{{:.4f}}', e.mae) AS mae,
  format('{{:.4f}}', e.mse) AS mse, coalesce(format('{{:.4f}}', p.pearson), 'NaN') AS pearson
FROM (SELECT channel_idx, sum(abs(coalesce(yhat, 0) - y)) / count(*) AS mae, sum((coalesce(yhat, 0) - y) ** 2) / count(*) AS mse
  FROM {FORECAST_SQL} GROUP BY ROLLUP (channel_idx)) e
JOIN (SELECT channel_idx, avg(CASE WHEN {COUNTED} THEN {R} END) AS pearson FROM (
  SELECT sample_id, channel_idx, count(*) AS n, covar_pop(coalesce(yhat, 0), y) * count(*) AS num,
    var_pop(coalesce(yhat, 0)) * count(*) AS dx, var_pop(y) * count(*) AS dy FROM {FORECAST_SQL} GROUP BY ALL)
  GROUP BY ROLLUP (channel_idx)) p ON p.channel_idx IS NOT DISTINCT FROM e.channel_idx""",
)
def _(spark, d):
    """Records to the published report: days, windows, the 5-2 day split, a baseline forecast, aligned cells, metrics."""
    rows = samples.window_samples(stages.window_table(spark, d), stages.day_runs(spark, d), runs=True)
    forecast = evaluate.last_day_forecast(samples.split_days(rows, *samples.forecast_minutes("5-2d")))
    # Cells that nothing was observed in leave with "mask = 1"; days without any other leave before they are cells.
    seen = forecast.where(F.array_contains("mask", F.lit(1).cast("tinyint")))
    cells, key = evaluate.forecast_cells(seen), ["sample_id", "channel_idx", "role_day", "minute"]
    names = spark.createDataFrame(list(enumerate(C.CHANNELS)), "channel_idx int, channel string")
    return evaluate.report(cells.where("mask = 1").select(*key, "y", "yhat", "mask"), names)
