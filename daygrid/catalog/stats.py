"""Aggregations and statistics (inventory sections A and O, and the record reports of C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.catalog.registry import query, rounded, rounded_all
from daygrid.catalog.sql import rd
from daygrid.operators import grid, labels, recode, splits, stats, summary, windows
from daygrid.plans import stages
from daygrid.plans.grid import day_statistics
from daygrid.sources import adapter

DAY = ["participant_id", "date"]
GROUP_SQL = {
    "WorkoutsAny": "BETWEEN 6 AND 15",
    "WorkoutsRunning": "= 8",
    "WorkoutsCycling": "= 7",
    "HeartRate": "= 5",
    "StepsTaken": "= 0",
    "DistanceWalkingRunning": "= 2",
    "DistanceCycling": "= 3",
    "ActiveCaloriesBurned": "= 1",
    "SleepAny": "IN (16, 17)",
}


@query(
    "a01_coverage",
    f"""SELECT participant_id, date, CAST(channel_idx AS INTEGER) AS channel_idx,
{rd('count(*) * 1e2 / 1440')} AS data_coverage FROM minutes WHERE value <> 0 GROUP BY ALL""",
)
def _(spark, d):
    return rounded_all(stats.coverage(stages.minutes(spark, d)))


@query(
    "a02_channel_statistics",
    f"""SELECT participant_id, date, CAST(channel_idx AS INTEGER) AS channel_idx, CAST(count(*) AS DOUBLE) AS n,
{rd('sum(value)', 3)} AS sum, {rd('sum(value * value)', 2)} AS sum_of_squares FROM minutes WHERE value <> 0 GROUP BY ALL""",
)
def _(spark, d):
    return stats.channel_statistics(stages.minutes(spark, d)).select(
        *grid.KEY,
        "n",
        rounded("sum", 3).alias("sum"),
        rounded("sum_of_squares", 2).alias("sum_of_squares"),
    )


@query(
    "a03_day_stats",
    f"""SELECT participant_id, date, feature_index, {rd('data_coverage')} AS data_coverage, n,
{rd('sum', 3)} AS sum, {rd('sum_of_squares', 2)} AS sum_of_squares, original_time_offset FROM stats""",
)
def _(spark, d):
    return _rounded_stats(day_statistics(adapter.records(spark, d)))


def _rounded_stats(df):
    return df.select(
        "participant_id",
        "date",
        "feature_index",
        rounded("data_coverage").alias("data_coverage"),
        "n",
        rounded("sum", 3).alias("sum"),
        rounded("sum_of_squares", 2).alias("sum_of_squares"),
        "original_time_offset",
    )


STANDARD_SQL = f"""SELECT feature_index, {rd('sum(sum) / sum(n)')} AS mean,
{rd('sqrt(greatest(0, sum(sum_of_squares) / sum(n) - (sum(sum) / sum(n)) ** 2))', 4)} AS std_dev
FROM stats GROUP BY feature_index"""


@query("a04_standardization", STANDARD_SQL)
def _(spark, d):
    df = stats.standardization(stages.day_stats(spark, d))
    return df.select("feature_index", rounded("mean").alias("mean"), rounded("std_dev", 4).alias("std_dev"))


@query(
    "a04b_standardization_from_sources",
    f"""SELECT feature_index, {rd('sum(sum) / sum(n)')} AS mean,
{rd('sqrt(greatest(0, sum(sum_of_squares) / sum(n) - (sum(sum) / sum(n)) ** 2))', 4)} AS std_dev
FROM (SELECT * FROM stats WHERE NOT (participant_id % 2 = 1 AND feature_index = 5)) GROUP BY feature_index""",
)
def _(spark, d):
    df = stages.day_stats(spark, d)
    even = df.where(F.col("participant_id") % 2 == 0)
    nan = F.when(F.col("feature_index") != 5, F.col("sum")).otherwise(F.lit(float("nan")))
    odd = df.where(F.col("participant_id") % 2 == 1).withColumn("sum", nan)
    broken = df.drop("sum_of_squares")
    textual = df.withColumn("n", F.lit("many"))
    out = stats.standardization_from_sources([even, broken, odd, textual])
    return out.select("feature_index", rounded("mean").alias("mean"), rounded("std_dev", 4).alias("std_dev"))


@query(
    "a05_day_summary",
    f"""SELECT participant_id, date, {rd('data_coverage_sum')} AS data_coverage_sum,
{rd('data_coverage_mean')} AS data_coverage_mean, n_above_zero FROM summary""",
)
def _(spark, d):
    return rounded_all(stages.day_summary(spark, d))


@query(
    "a06_group_coverage",
    "SELECT participant_id, date, "
    + ", ".join(
        rd(f"coalesce(sum(data_coverage) FILTER (feature_index {cond}), 0)") + f' AS "{g}_coverage_sum"'
        for g, cond in GROUP_SQL.items()
    )
    + " FROM stats GROUP BY ALL",
)
def _(spark, d):
    return rounded_all(stats.group_coverage(stages.day_stats(spark, d)))


@query(
    "a07_group_report",
    " UNION ALL ".join(
        f"""SELECT '{g}' AS modality_group, count(*) FILTER (c > 0) AS days_with_coverage,
count(DISTINCT participant_id) FILTER (c > 0) AS unique_participants,
CAST(sum(round(c * 14.4e0)) AS BIGINT) AS estimated_data_points
FROM (SELECT participant_id, date, sum(data_coverage) AS c FROM stats WHERE feature_index {cond} GROUP BY ALL)"""
        for g, cond in GROUP_SQL.items()
    ),
)
def _(spark, d):
    return stats.group_report(stats.group_coverage(stages.day_stats(spark, d)))


@query(
    "a08_days_per_participant",
    "SELECT participant_id, count(DISTINCT date) AS n_days, count(*) AS n_rows FROM summary GROUP BY ALL",
)
def _(spark, d):
    return stats.days_per_participant(stages.day_summary(spark, d))


def _values(numbers) -> str:
    return ", ".join(f"({n})" for n in numbers)


@query(
    "a09_threshold_ladders",
    f"""SELECT 'participants_with_more_days' AS ladder, t AS threshold,
  (SELECT count(*) FROM (SELECT participant_id, count(*) AS c FROM summary GROUP BY ALL) WHERE c > t) AS n
FROM (VALUES {_values(C.PARTICIPANT_DAY_THRESHOLDS)}) v(t)
UNION ALL SELECT 'days_with_at_least_channels', t, (SELECT count(*) FROM summary WHERE n_above_zero >= t)
FROM (VALUES {_values(C.CHANNEL_COUNT_THRESHOLDS)}) v(t)
UNION ALL SELECT 'participants_with_more_channels', t,
  (SELECT count(DISTINCT participant_id) FROM summary WHERE n_above_zero > t)
FROM (VALUES {_values(C.CHANNEL_COUNT_THRESHOLDS)}) v(t)""",
)
def _(spark, d):
    return stats.threshold_ladders(stages.day_summary(spark, d))


@query(
    "a10_coverage_quantile",
    f"SELECT CAST(0.25 AS DOUBLE) AS probability, {rd('quantile_cont(data_coverage_sum, 0.25)')} AS data_coverage_sum FROM summary",
)
def _(spark, d):
    return rounded_all(stats.coverage_quantile(stages.day_summary(spark, d)), skip=("probability",))


@query(
    "a11_selected_days",
    f"""SELECT participant_id, date, {rd('data_coverage_sum')} AS data_coverage_sum, n_above_zero FROM summary
WHERE data_coverage_sum > (SELECT quantile_cont(data_coverage_sum, 0.25) FROM summary) AND n_above_zero > 2""",
)
def _(spark, d):
    df = stats.selected_days(stages.day_summary(spark, d), more_channels_than=2)
    return rounded_all(df.drop("data_coverage_mean"))


@query(
    "a11b_days_with_any_data",
    "SELECT count(*) AS days, count(DISTINCT participant_id) AS participants FROM summary WHERE data_coverage_sum > 0",
)
def _(spark, d):
    any_data = stats.days_with_any_data(stages.day_summary(spark, d))
    per_participant = any_data.groupBy("participant_id").agg(F.count("*").alias("days"))
    return per_participant.agg(F.sum("days").alias("days"), F.count("*").alias("participants"))


DEVICE_SQL = f"""(SELECT participant_id, source, CASE
  WHEN bool_or(modality = 'healthkit' AND type = '{C.HEART_RATE}' AND source_identifier LIKE '%com.apple.health.%') THEN 'AppleWatch'
  WHEN bool_or(modality = 'healthkit' AND type <> '{C.HEART_RATE}' AND source_identifier LIKE '%com.apple.health.%') THEN 'iPhone'
  ELSE 'Unknown' END AS device FROM rec GROUP BY participant_id, source)"""
LOC_DEVICE = f"(SELECT l.*, v.device FROM locd l JOIN {DEVICE_SQL} v USING (participant_id, source))"


def _with_device(spark, d):
    classes = recode.device_classes(adapter.records(spark, d))
    return stages.local_records(spark, d).join(classes, ["participant_id", "source"])


@query(
    "a12_robust_stats",
    f"""SELECT device, type, {rd('sum(value)', 2)} AS sum, {rd('avg(value)', 4)} AS mean,
{rd('quantile_cont(value, 0.25)', 4)} AS q25, {rd('quantile_cont(value, 0.5)', 4)} AS median,
{rd('quantile_cont(value, 0.75)', 4)} AS q75,
{rd('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 4)} AS iqr
FROM {LOC_DEVICE} WHERE modality = 'healthkit' GROUP BY device, type""",
)
def _(spark, d):
    df = _with_device(spark, d).where(F.col("modality") == C.QUANTITY)
    out = summary.robust_stats(df, ["device", "type"])
    return out.select(
        "device",
        "type",
        rounded("sum", 2).alias("sum"),
        *[rounded(c, 4).alias(c) for c in ("mean", "q25", "median", "q75", "iqr")],
    )


@query(
    "a13_sleep_seconds",
    f"""SELECT device, {rd(f"sum(value) FILTER (category = '{C.IN_BED}')", 2)} AS seconds_in_bed,
{rd(f"sum(value) FILTER (category = '{C.ASLEEP}')", 2)} AS seconds_asleep
FROM {LOC_DEVICE} WHERE modality = 'sleep' GROUP BY device""",
)
def _(spark, d):
    df = _with_device(spark, d).where(F.col("modality") == C.SLEEP)
    return rounded_all(summary.sleep_seconds(df, ["device"]), 2)


@query(
    "a14_workout_seconds",
    f"""SELECT k.participant_id, k.date, k.workout_type, {rd('coalesce(sum((l.end_us - l.start_us) / 1e6), 0)', 3)} AS delta
FROM (SELECT DISTINCT participant_id, date, unnest({[*C.WORKOUT_TYPES]}) AS workout_type FROM locd WHERE modality = 'workout') k
LEFT JOIN locd l ON l.participant_id = k.participant_id AND l.date = k.date AND l.workout_type = k.workout_type
GROUP BY k.participant_id, k.date, k.workout_type""",
)
def _(spark, d):
    df = stages.local_records(spark, d).where(F.col("modality") == C.WORKOUT)
    return rounded_all(summary.workout_seconds(df, DAY), 3)


@query(
    "a15_motion_seconds",
    f"""SELECT k.position, k.activity, {rd('coalesce(sum((l.end_us - l.start_us) / 1e6), 0)', 2)} AS delta
FROM (VALUES {", ".join(f"({i}, '{a}')" for i, a in enumerate(C.MOTION_REPORT_ORDER))}) k(position, activity)
LEFT JOIN locd l ON l.activity = k.activity GROUP BY k.position, k.activity""",
)
def _(spark, d):
    df = stages.local_records(spark, d).where(F.col("modality") == C.MOTION)
    return rounded_all(summary.motion_seconds(df, []), 2)


def _listed(kind: str, condition: str, column: str, names: list[str], amount: str) -> str:
    """Seconds of each listed name, also those without records."""
    values = ", ".join(f"('{n}')" for n in names)
    figure = "seconds" if kind == "sleep" else "delta"
    return f"""SELECT '{kind}' AS kind, k.name, '{figure}' AS figure, {rd(f"coalesce(sum({amount}), 0)", 2)} AS amount
FROM (VALUES {values}) k(name) LEFT JOIN locd l ON l.modality = '{condition}' AND l.{column} = k.name GROUP BY k.name"""


_SECONDS = "(l.end_us - l.start_us) / 1e6"
_ROBUST = {
    "sum": "sum(value)",
    "mean": "avg(value)",
    "q25": "quantile_cont(value, 0.25)",
    "median": "quantile_cont(value, 0.5)",
    "q75": "quantile_cont(value, 0.75)",
    "iqr": "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)",
}


@query(
    "a16_summary_by_kind",
    " UNION ALL ".join(
        [
            *(
                f"""SELECT 'robust' AS kind, type AS name, '{figure}' AS figure, {rd(sql, 2)} AS amount FROM locd
WHERE modality = 'healthkit' AND type <> '{C.HEART_RATE}' GROUP BY type"""
                for figure, sql in _ROBUST.items()
            ),
            f"""SELECT 'hourly', h.name, 'mean_value', {rd('avg(l.value)', 2)} FROM (SELECT lpad(CAST(unnest(range(0, 24)) AS VARCHAR), 2, '0') AS name) h
LEFT JOIN locd l ON l.type = '{C.HEART_RATE}' AND lpad(CAST((l.start_us % 86400000000) // 3600000000 AS VARCHAR), 2, '0') = h.name GROUP BY h.name""",
            _listed("sleep", "sleep", "category", [C.IN_BED, C.ASLEEP], "l.value"),
            _listed("workout", "workout", "workout_type", C.WORKOUT_TYPES, _SECONDS),
            _listed("motion", "motion", "activity", C.MOTION_REPORT_ORDER, _SECONDS),
        ]
    ),
)
def _(spark, d):
    return rounded_all(summary.summaries_by_kind(stages.local_records(spark, d)), 2)


@query(
    "a17_units_per_type",
    """SELECT type, array_to_string(list_sort(list(DISTINCT unit)), ',') AS units, count(*) AS records
FROM rec WHERE modality = 'healthkit' GROUP BY type""",
)
def _(spark, d):
    df = summary.units_per_type(adapter.records(spark, d).where(F.col("modality") == C.QUANTITY))
    return df.withColumn("units", F.array_join("units", ","))


def describe_sql(source: str, columns: list[str], group: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {group}, '{c}' AS variable, count({c}) AS n, {rd(f'avg({c})', 4)} AS mean,
{rd(f'stddev_samp({c})', 4)} AS std, {rd(f'min({c})', 4)} AS min, {rd(f'quantile_cont({c}, 0.25)', 4)} AS q25,
{rd(f'quantile_cont({c}, 0.5)', 4)} AS q50, {rd(f'quantile_cont({c}, 0.75)', 4)} AS q75, {rd(f'max({c})', 4)} AS max
FROM {source} GROUP BY {group}"""
        for c in columns
    )


@query(
    "a18_describe",
    describe_sql(
        """(SELECT CASE WHEN coalesce(m.participant_id, a.participant_id) % 5 = 0 THEN 'test' ELSE 'train' END AS split,
a.age, m.weight_kg, m.height_cm FROM demo1 m FULL JOIN ages a ON a.participant_id = m.participant_id)""",
        ["age", "weight_kg", "height_cm"],
        "split",
    ),
)
def _(spark, d):
    df = splits.diagnostics(adapter.demographics(spark, d), adapter.participant_info(spark, d))
    df = df.withColumn("split", F.when(F.col("participant_id") % 5 == 0, "test").otherwise("train"))
    return rounded_all(stats.describe(df, ["split"], ["age", "weight_kg", "height_cm"]), 4)


@query(
    "a19_frequencies",
    f"""SELECT type AS value, count(*) AS n, {rd('count(*) / (sum(count(*)) OVER ())')} AS share
FROM rec WHERE type IS NOT NULL GROUP BY type""",
)
def _(spark, d):
    return rounded_all(stats.frequencies(adapter.records(spark, d), "type"))


@query("a20_labels_present", "SELECT participant_id, CAST(label_count AS INTEGER) AS label_count FROM sp")
def _(spark, d):
    return labels.labels_present(stages.flat(spark, d))


@query(
    "a21_label_means",
    "SELECT participant_id, "
    + ", ".join(rd(f'avg("{c}_value")') + f' AS "{c}_value"' for c in C.LABELS)
    + " FROM flat GROUP BY participant_id",
)
def _(spark, d):
    return rounded_all(labels.label_means(stages.flat(spark, d)))


NO_LABEL = "coalesce(" + ", ".join(f'"{c}_value"' for c in C.LABELS) + ") IS NULL"


@query(
    "a22_participants_without_labels",
    f"""SELECT participant_id, bool_and({NO_LABEL}) AS all_windows FROM flat
GROUP BY participant_id HAVING bool_or({NO_LABEL})""",
)
def _(spark, d):
    return labels.participants_without_labels(stages.flat(spark, d))


@query(
    "a23_array_summary",
    f"""SELECT CAST(count(*) FILTER (vec_id % 9 <> i % 9) AS BIGINT) AS n_valid,
CAST(count(*) FILTER (vec_id % 9 = i % 9) AS BIGINT) AS n_nan,
{rd('min(v) FILTER (vec_id % 9 <> i % 9)')} AS min_value, {rd('max(v) FILTER (vec_id % 9 <> i % 9)')} AS max_value,
{rd('avg(v) FILTER (vec_id % 9 <> i % 9)')} AS mean_value FROM vec""",
)
def _(spark, d):
    df = adapter.vector_days(spark, d).select(
        F.transform(
            "values",
            lambda v, i: F.when(i % 9 == F.col("vec_id") % 9, F.lit(float("nan"))).otherwise(v),
        ).alias("values")
    )
    return rounded_all(stats.array_summary(df, "values"))


WINDOW_FLAGS_SQL = """SELECT participant_id,
  bool_or(first_day + 6 <= last_day AND n7 >= 5) AS has_7day_window,
  bool_or(first_day + 13 <= last_day AND n14 >= 10) AS has_14day_window
FROM (SELECT b.participant_id, b.day AS first_day, b.last_day, count(q.date) FILTER (q.date <= b.day + 6) AS n7,
        count(q.date) FILTER (q.date <= b.day + 13) AS n14
  FROM (SELECT participant_id, last_day, unnest(generate_series(first_day, last_day, INTERVAL 1 DAY))::DATE AS day
        FROM (SELECT participant_id, min(date) AS first_day, max(date) AS last_day FROM quality GROUP BY ALL)) b
  LEFT JOIN quality q ON q.participant_id = b.participant_id AND q.date BETWEEN b.day AND b.day + 13
  GROUP BY ALL) GROUP BY participant_id"""


@query(
    "a24_qualifying_report",
    f"""SELECT rule, n, participants, {rd('n * 1e2 / participants')} AS percent FROM (
SELECT 'has_7day_window' AS rule, count(*) FILTER (has_7day_window) AS n, count(*) AS participants FROM ({WINDOW_FLAGS_SQL})
UNION ALL SELECT 'has_14day_window', count(*) FILTER (has_14day_window), count(*) FROM ({WINDOW_FLAGS_SQL}))""",
)
def _(spark, d):
    flags = windows.qualifying_participants(stages.quality(spark, d))
    return rounded_all(windows.qualifying_report(flags))


# --- sort, distinct, limit ----------------------------------------------------------------------------


@query("o01_sorted_records", "SELECT participant_id, record_id, start_us FROM rec")
def _(spark, d):
    return adapter.records(spark, d).select("participant_id", "record_id", "start_us").orderBy(
        "start_us", "record_id"
    )


@query("o02_distinct_days", "SELECT DISTINCT participant_id, date FROM locd")
def _(spark, d):
    return stages.local_records(spark, d).select(*DAY).distinct()


@query(
    "o03_first_rows",
    "SELECT record_id, start_us FROM rec ORDER BY start_us, record_id LIMIT 10",
)
def _(spark, d):
    df = adapter.records(spark, d).select("record_id", "start_us")
    return df.orderBy("start_us", "record_id").limit(10)


@query(
    "o03b_first_channels",
    f"SELECT feature_index, {rd('sum(n)', 1)} AS n FROM stats WHERE feature_index < 6 GROUP BY feature_index",
)
def _(spark, d):
    df = stages.day_stats(spark, d).where(F.col("feature_index") < 6)
    return rounded_all(df.groupBy("feature_index").agg(F.sum("n").alias("n")), 1)


@query(
    "o04_first_per_key",
    "SELECT participant_id, record_id, modality FROM rec QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY start_us, record_id) = 1",
)
def _(spark, d):
    df = adapter.records(spark, d).select("participant_id", "record_id", "modality", "start_us")
    first = recode.first_per_key(df, ["participant_id"], [F.col("start_us"), F.col("record_id")])
    return first.drop("start_us")
