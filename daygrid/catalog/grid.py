"""Interval and time-grid operators (inventory section I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.catalog.registry import query, rounded, rounded_all
from daygrid.catalog.sql import rd
from daygrid.functions import arrays as A
from daygrid.operators import clean, grid, intervals, samples, summary
from daygrid.plans import stages
from daygrid.plans.grid import day_grid
from daygrid.sources import adapter

DAY = ["participant_id", "date"]


@query(
    "i01_midnight_split",
    f"""SELECT record_id, CAST(part AS INTEGER) AS part, start_us, end_us, {rd('value', 4)} AS value
FROM parts WHERE modality <> 'sleep'""",
)
def _(spark, d):
    df = clean.to_local_time(clean.keep_plausible(clean.normalise_units(adapter.records(spark, d))))
    out = intervals.split_at_midnight(df.where(F.col("modality") != C.SLEEP))
    return out.select("record_id", "part", "start_us", "end_us", rounded("value", 4).alias("value"))


@query(
    "i02_sleep_split",
    f"""SELECT record_id, CAST(part AS INTEGER) AS part, start_us, end_us, {rd('(end_us - start_us) / 1e6', 3)} AS value
FROM parts WHERE modality = 'sleep'""",
)
def _(spark, d):
    df = clean.to_local_time(clean.keep_plausible(adapter.records(spark, d)))
    out = intervals.split_sleep_at_midnight(df.where(F.col("modality") == C.SLEEP))
    return out.select("record_id", "part", "start_us", "end_us", rounded("value", 3).alias("value"))


@query(
    "i03_local_dates",
    "SELECT participant_id, date, modality, count(*) AS n FROM parts GROUP BY ALL",
)
def _(spark, d):
    return stages.parts(spark, d).groupBy(*DAY, "modality").agg(F.count("*").alias("n"))


@query(
    "i04_second_means",
    f"""SELECT participant_id, date, CAST(channel_idx AS INTEGER) AS channel_idx, count(*) AS seconds,
CAST(min(sec) AS INTEGER) AS first_second, CAST(max(sec) AS INTEGER) AS last_second,
{rd('avg(v)')} AS mean_value, {rd('max(v)')} AS max_value FROM sec GROUP BY ALL""",
)
def _(spark, d):
    measured = stages.parts(spark, d).where(F.col("modality").isin(C.QUANTITY, C.MOTION))
    length = F.col("sec_end") - F.col("sec")
    return grid.mean_segments(grid.second_intervals(measured)).groupBy(*grid.KEY).agg(
        F.sum(length).alias("seconds"),
        F.min("sec").alias("first_second"),
        (F.max("sec_end") - 1).alias("last_second"),
        rounded(F.sum(F.col("v") * length) / F.sum(length)).alias("mean_value"),
        rounded(F.max("v")).alias("max_value"),
    )


@query(
    "i05_minute_means",
    f"""SELECT participant_id, date, CAST(channel_idx AS INTEGER) AS channel_idx, CAST(sec // 60 AS INTEGER) AS minute,
CAST(count(*) AS INTEGER) AS covered_seconds, {rd('avg(v)')} AS value FROM sec GROUP BY ALL""",
)
def _(spark, d):
    measured = stages.parts(spark, d).where(F.col("modality").isin(C.QUANTITY, C.MOTION))
    return rounded_all(grid.minute_means(grid.mean_segments(grid.second_intervals(measured))))


def _modality(name: str, modality: str) -> None:
    sql = f"""SELECT p.participant_id, p.date, CAST(p.channel_idx AS INTEGER) AS channel_idx, m.minute,
{rd('m.value')} AS value
FROM (SELECT DISTINCT participant_id, date, channel_idx FROM parts WHERE modality = '{modality}') p
LEFT JOIN allmin m ON m.participant_id = p.participant_id AND m.date = p.date AND m.channel_idx = p.channel_idx"""

    @query(name, sql)
    def _(spark, d):
        return rounded_all(grid.modality_grid(stages.parts(spark, d), modality))


_modality("i06_quantity_grid", C.QUANTITY)
_modality("i07_motion_grid", C.MOTION)
_modality("i08_sleep_grid", C.SLEEP)
_modality("i09_workout_grid", C.WORKOUT)


@query(
    "i10_day_matrix",
    f"""SELECT c.participant_id, c.date, CAST(c.channel_idx AS INTEGER) AS channel_idx, CAST(1440 AS INTEGER) AS length,
CAST(CASE WHEN c.zero_fill THEN 0 ELSE 1440 - count(m.value) END AS INTEGER) AS n_missing,
CAST(count(*) FILTER (m.value = 0) + CASE WHEN c.zero_fill THEN 1440 - count(m.value) ELSE 0 END AS INTEGER) AS n_zero,
{rd('coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE)), 0)', 3)} AS total
FROM chanday c LEFT JOIN minutes m ON m.participant_id = c.participant_id AND m.date = c.date
  AND m.channel_idx = c.channel_idx GROUP BY c.participant_id, c.date, c.channel_idx, c.zero_fill""",
)
def _(spark, d):
    return day_grid(adapter.records(spark, d)).select(
        *grid.KEY,
        F.size("values").alias("length"),
        A.total("values", lambda v: F.isnan(v).cast("int"), "int").alias("n_missing"),
        A.total("values", lambda v: (v == 0).cast("int"), "int").alias("n_zero"),
        rounded(A.total("values", lambda v: F.nanvl(v.cast("double"), F.lit(0.0))), 3).alias("total"),
    )


@query(
    "i11_observation_mask",
    """SELECT c.participant_id, c.date, CAST(c.channel_idx AS INTEGER) AS channel_idx,
CAST(count(m.value) AS INTEGER) AS observed, CAST(coalesce(sum(m.minute), 0) AS BIGINT) AS minute_sum
FROM chanday c LEFT JOIN (SELECT * FROM minutes WHERE value <> 0) m ON m.participant_id = c.participant_id
  AND m.date = c.date AND m.channel_idx = c.channel_idx GROUP BY c.participant_id, c.date, c.channel_idx""",
)
def _(spark, d):
    df = stages.day_channel(spark, d)
    mask = grid.observation_mask(F.col("values"))
    sums = A.with_sums(df.select(*grid.KEY, mask.alias("_m")), grid.KEY, {"m": "_m"})
    return sums.select(
        *grid.KEY,
        F.col("m.plain").cast("int").alias("observed"),
        (F.col("m.weighted") - F.col("m.total")).cast("long").alias("minute_sum"),
    )


@query("i12_output_days", "SELECT participant_id, date FROM days")
def _(spark, d):
    return intervals.output_days(stages.parts(spark, d))


@query("i13_original_offsets", "SELECT participant_id, date, original_time_offset FROM days")
def _(spark, d):
    return intervals.original_offsets(stages.parts(spark, d))


@query(
    "i12b_days_without_quantity",
    """SELECT participant_id, date, count(DISTINCT channel_idx) AS channels FROM parts
WHERE modality <> 'healthkit' GROUP BY ALL""",
)
def _(spark, d):
    parts = clean.without_modalities(stages.parts(spark, d), [C.QUANTITY])
    days = intervals.day_index(parts, skip_quantity=True)
    return days.select(*DAY, F.bit_count("channel_bits").cast("long").alias("channels"))


def _rounded_sums(sums, suffix="", digits=1):
    """Sum of an array's values and of their products with their places."""
    return [rounded(f"{sums}.total", 3).alias(f"total{suffix}"), rounded(f"{sums}.weighted", digits).alias(f"weighted{suffix}")]


SEGMENT_SQL = f"""SELECT s.participant_id, s.start_date, s.segment, CAST(720 AS INTEGER) AS length,
CAST(count(m.value) FILTER (m.value <> 0) AS INTEGER) AS observed, {rd('coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE)), 0)', 3)} AS total,
{rd('coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE) * (m.channel_idx * 30 + m.minute % 30 + 1)), 0)', 2)} AS weighted
FROM (SELECT participant_id, start_date, CAST(unnest(range(0, 336)) AS INTEGER) AS segment FROM win) s
LEFT JOIN wmin m ON m.participant_id = s.participant_id AND m.start_date = s.start_date
  AND m.day_index * 48 + m.minute // 30 = s.segment
GROUP BY s.participant_id, s.start_date, s.segment"""


@query("i14_segments", SEGMENT_SQL)
def _(spark, d):
    by_day = ("day_index", "channel_idx")
    rows = samples.with_placeholders(stages.window_table(spark, d), stages.day_runs(spark, d), order=by_day, runs=True)
    cut = samples.segments(rows)
    key = ["participant_id", "start_date", "segment"]
    observed = A.count_of_others("mask", F.lit(0).cast("tinyint")).alias("observed")
    sums = A.with_sums(cut, [*key, F.size("values").alias("length"), observed], {"v": "values"})
    return sums.select(*key, "length", "observed", *_rounded_sums("v", digits=2))


@query(
    "i15_flatten_days",
    f"""SELECT w.participant_id, w.start_date, CAST(c.channel_idx AS INTEGER) AS channel_idx, CAST(10080 AS INTEGER) AS length,
CAST(count(m.value) FILTER (m.value <> 0) AS INTEGER) AS observed,
CAST(coalesce(min(m.day_index * 1440 + m.minute) FILTER (m.value <> 0), -1) AS INTEGER) AS first_position,
CAST(coalesce(max(m.day_index * 1440 + m.minute) FILTER (m.value <> 0), -1) AS INTEGER) AS last_position,
{rd('coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE)), 0)', 3)} AS total,
{rd('coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE) * (m.day_index * 1440 + m.minute + 1)), 0)', 1)} AS weighted
FROM win w, (SELECT unnest(range(0, 24)) AS channel_idx) c
LEFT JOIN wmin m ON m.participant_id = w.participant_id AND m.start_date = w.start_date AND m.channel_idx = c.channel_idx
GROUP BY w.participant_id, w.start_date, c.channel_idx""",
)
def _(spark, d):
    rows = samples.with_placeholders(stages.window_table(spark, d), stages.day_runs(spark, d), runs=True)
    flat, one, key = samples.flatten_days(rows), F.lit(1).cast("tinyint"), ["participant_id", "start_date", "channel_idx"]
    first = F.coalesce(F.nullif(F.array_position("mask", one), F.lit(0)) - 1, F.lit(-1)).cast("int")
    last = F.when(F.array_contains("mask", one), F.size("mask") - F.array_position(F.reverse("mask"), one)).otherwise(F.lit(-1))
    observed = A.count_of_others("mask", F.lit(0).cast("tinyint")).alias("observed")
    kept = [F.size("values").alias("length"), observed, first.alias("first_position"), last.cast("int").alias("last_position")]
    sums = A.with_cell_sums(flat, [*key, "end_date", *kept], "values")
    return sums.select(*key, "length", "observed", "first_position", "last_position", *_rounded_sums("v"))


@query(
    "i16_placeholder_days",
    """SELECT w.participant_id, w.start_date, w.day_index, w.date, CAST(c.channel_idx AS INTEGER) AS channel_idx,
d.date IS NULL AS is_placeholder,
CAST(CASE WHEN d.date IS NULL THEN 1440 WHEN c2.zero_fill THEN 0 ELSE 1440 - coalesce(m.n, 0) END AS INTEGER) AS n_missing
FROM wdays w CROSS JOIN (SELECT unnest(range(0, 24)) AS channel_idx) c
LEFT JOIN days d ON d.participant_id = w.participant_id AND d.date = w.date
LEFT JOIN chanday c2 ON c2.participant_id = w.participant_id AND c2.date = w.date AND c2.channel_idx = c.channel_idx
LEFT JOIN (SELECT participant_id, date, channel_idx, count(*) AS n FROM minutes GROUP BY ALL) m
  ON m.participant_id = w.participant_id AND m.date = w.date AND m.channel_idx = c.channel_idx""",
)
def _(spark, d):
    df = samples.with_placeholders(stages.window_table(spark, d), stages.day_runs(spark, d))
    return df.select(
        "participant_id",
        "start_date",
        "day_index",
        "date",
        "channel_idx",
        "is_placeholder",
        A.total("values", lambda v: F.isnan(v).cast("int"), "int").alias("n_missing"),
    )


@query(
    "i17_window_samples",
    f"""SELECT w.participant_id, w.start_date, w.day_index, CAST(c.channel_idx AS INTEGER) AS channel_idx,
CAST(count(m.value) AS INTEGER) AS observed,
{rd('coalesce(sum((CAST(CAST(m.value AS FLOAT) AS DOUBLE) - coalesce(p.mean, 0)) / coalesce(p.sd, 1)), 0)', 2)} AS total
FROM wdays w CROSS JOIN (SELECT unnest(range(0, 24)) AS channel_idx) c
LEFT JOIN (SELECT feature_index, sum(sum) / sum(n) AS mean,
   sqrt(greatest(0, sum(sum_of_squares) / sum(n) - (sum(sum) / sum(n)) ** 2)) AS sd
   FROM stats WHERE n > 0 GROUP BY feature_index HAVING sd >= 1e-9) p ON p.feature_index = c.channel_idx
LEFT JOIN (SELECT * FROM wmin WHERE value <> 0) m ON m.participant_id = w.participant_id
  AND m.start_date = w.start_date AND m.day_index = w.day_index AND m.channel_idx = c.channel_idx
GROUP BY w.participant_id, w.start_date, w.day_index, c.channel_idx""",
)
def _(spark, d):
    df = samples.window_samples(
        stages.window_table(spark, d),
        stages.day_runs(spark, d),
        standardization=stages.standardization(spark, d),
    )
    key = ["participant_id", "start_date", "day_index", "channel_idx"]
    sums = A.with_sums(df, key, {"m": "mask", "v": "values"})
    return sums.select(*key, F.col("m.plain").cast("int").alias("observed"), rounded("v.plain", 2).alias("total"))


@query(
    "i18_forecast_split_text",
    """SELECT event_id, CASE WHEN event_id % 7 < 5 THEN CAST((event_id % 9 + 1) * 1440 AS INTEGER) END AS sequence_len,
CASE WHEN event_id % 7 < 5 THEN CAST((user_id % 4 + 1) * 1440 AS INTEGER) END AS prediction_horizon FROM events""",
)
def _(spark, d):
    text = F.concat(
        (F.col("event_id") % 9 + 1).cast("string"),
        F.lit("-"),
        (F.col("user_id") % 4 + 1).cast("string"),
        F.when(F.col("event_id") % 7 < 5, "d").when(F.col("event_id") % 7 == 5, "h").otherwise("d-1d"),
    )
    return adapter.table(spark, d, "events").select(
        "event_id", samples.split_minutes(text).alias("s")
    ).select("event_id", "s.sequence_len", "s.prediction_horizon")


@query(
    "i19_split_by_day",
    f"""SELECT w.participant_id, w.start_date, r.role, CAST(w.day_index - r.first AS INTEGER) AS role_day,
CAST(c.channel_idx AS INTEGER) AS channel_idx, CAST(count(m.value) AS INTEGER) AS observed,
{rd('coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE)), 0)', 3)} AS total,
{rd('coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE) * (m.minute + 1)), 0)', 1)} AS weighted
FROM wdays w JOIN (VALUES ('x', 0, 5), ('y', 4, 6)) r(role, first, past) ON w.day_index >= r.first AND w.day_index < r.past
CROSS JOIN (SELECT unnest(range(0, 24)) AS channel_idx) c
LEFT JOIN (SELECT * FROM wmin WHERE value <> 0) m ON m.participant_id = w.participant_id
  AND m.start_date = w.start_date AND m.day_index = w.day_index AND m.channel_idx = c.channel_idx
GROUP BY w.participant_id, w.start_date, r.role, w.day_index - r.first, c.channel_idx""",
)
def _(spark, d):
    inputs, horizon = samples.forecast_minutes("5-2d")
    rows = samples.with_placeholders(stages.window_table(spark, d), stages.day_runs(spark, d))
    out = samples.split_days(rows, inputs, horizon, C.MINUTES_PER_DAY)
    key = ["participant_id", "start_date", "role", "role_day", "channel_idx"]
    sums = A.with_sums(out, key, {"m": "mask", "v": "values"})
    return sums.select(*key, F.col("m.plain").cast("int").alias("observed"), *_rounded_sums("v"))


_AT = "m.day_index * 1440 + m.minute"
_VALUE = "CAST(CAST(m.value AS FLOAT) AS DOUBLE)"
_IN = f"FILTER ({_AT} BETWEEN {{first}} AND {{last}})"
_PART_SQL = (
    rd(f"coalesce(sum({_VALUE}) {_IN}, 0)", 3) + " AS total_{name}, "
    + rd(f"coalesce(sum({_VALUE} * ({_AT} - {{first}} + 1)) {_IN}, 0)", 1) + " AS weighted_{name}"
)


@query(
    "i20_split_by_minute",
    f"""SELECT w.participant_id, w.start_date, CAST(c.channel_idx AS INTEGER) AS channel_idx,
{_PART_SQL.format(name='x', first=0, last=5999)}, {_PART_SQL.format(name='y', first=5900, last=8899)},
CAST(6000 AS INTEGER) AS length_x, CAST(3000 AS INTEGER) AS length_y,
CAST(count(m.value) FILTER (m.day_index * 1440 + m.minute < 6000) AS INTEGER) AS observed_x,
CAST(count(m.value) FILTER (m.day_index * 1440 + m.minute BETWEEN 5900 AND 8899) AS INTEGER) AS observed_y
FROM win w CROSS JOIN (SELECT unnest(range(0, 24)) AS channel_idx) c
LEFT JOIN (SELECT * FROM wmin WHERE value <> 0) m ON m.participant_id = w.participant_id
  AND m.start_date = w.start_date AND m.channel_idx = c.channel_idx
GROUP BY w.participant_id, w.start_date, c.channel_idx""",
)
def _(spark, d):
    rows = samples.with_placeholders(stages.window_table(spark, d), stages.day_runs(spark, d))
    out = samples.split_flat(samples.flatten_days(rows), 6000, 3000, 100)

    key = ["participant_id", "start_date", "channel_idx"]
    lengths = [F.size("data_x").alias("length_x"), F.size("data_y").alias("length_y")]
    sums = A.with_sums(out, [*key, *lengths], {c: c for c in ("mask_x", "mask_y", "data_x", "data_y")})
    return sums.select(
        *key,
        "length_x",
        "length_y",
        F.col("mask_x.plain").cast("int").alias("observed_x"),
        F.col("mask_y.plain").cast("int").alias("observed_y"),
        *_rounded_sums("data_x", "_x"),
        *_rounded_sums("data_y", "_y"),
    )


@query(
    "i21_minute_resample",
    f"""SELECT participant_id, source AS device, start_us - start_us % 60000000 AS start_us,
start_us - start_us % 60000000 + 60000000 AS end_us, {rd('avg(value)', 4)} AS value, count(*) AS records,
arg_min(unit, (start_us, record_id)) AS unit, arg_min(app_version, (start_us, record_id)) AS app_version
FROM locd WHERE modality = 'healthkit' GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    df = stages.local_records(spark, d).where(F.col("modality") == C.QUANTITY)
    df = df.withColumnRenamed("source", "device")
    return rounded_all(summary.resample_minutes(df, ["participant_id", "device"]), 4)


@query(
    "i22_hourly_means",
    f"""SELECT k.participant_id, k.date, k.hour, {rd('avg(l.value)')} AS mean_value
FROM (SELECT participant_id, date, CAST(unnest(range(0, 24)) AS INTEGER) AS hour FROM
  (SELECT DISTINCT participant_id, date FROM locd WHERE type = '{C.HEART_RATE}')) k
LEFT JOIN locd l ON l.type = '{C.HEART_RATE}' AND l.participant_id = k.participant_id AND l.date = k.date
  AND (l.start_us % 86400000000) // 3600000000 = k.hour GROUP BY k.participant_id, k.date, k.hour""",
)
def _(spark, d):
    df = stages.local_records(spark, d).where(F.col("type") == C.HEART_RATE)
    return rounded_all(summary.hourly_means(df, DAY))
