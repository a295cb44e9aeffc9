"""Day windows (inventory section W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.catalog.registry import query, rounded
from daygrid.catalog.sql import rd
from daygrid.catalog.stats import WINDOW_FLAGS_SQL
from daygrid.operators import windows
from daygrid.plans import stages

DAYS_TEXT = "array_to_string([strftime(x, '%Y-%m-%d') for x in {c}], ',')"


def _text(column):
    return F.array_join(F.transform(column, lambda x: F.date_format(x, "yyyy-MM-dd")), ",")


@query(
    "w01_day_quality",
    f"""SELECT participant_id, date, {rd('data_coverage_sum')} AS total_coverage, n_above_zero AS channels_with_data,
data_coverage_sum >= 7.6389e0 AND n_above_zero >= 2 AS valid FROM summary""",
)
def _(spark, d):
    out = windows.day_quality(stages.day_stats(spark, d), 7.6389, 2)
    return out.withColumn("total_coverage", rounded("total_coverage"))


@query(
    "w01b_day_quality_single_criteria",
    """SELECT participant_id, date, data_coverage_sum >= 1e1 AS by_coverage, n_above_zero >= 3 AS by_channels,
true AS by_nothing FROM summary""",
)
def _(spark, d):
    stats = stages.day_stats(spark, d)
    key = ["participant_id", "date"]

    def one(name, coverage, channels):
        return windows.day_quality(stats, coverage, channels).select(*key, F.col("valid").alias(name))

    return (
        one("by_coverage", 10.0, None)
        .join(one("by_channels", None, 3), key)
        .join(one("by_nothing", None, None), key)
    )


@query(
    "w02_valid_days",
    f"""SELECT participant_id, {DAYS_TEXT.format(c="list_sort(list(date) FILTER (valid))")} AS valid_days
FROM quality GROUP BY participant_id""",
)
def _(spark, d):
    days = windows.participant_days(stages.quality(spark, d))
    return days.select("participant_id", _text(windows.as_dates(F.col("valid_days"))).alias("valid_days"))


@query("w03_greedy_windows", "SELECT participant_id, start_day AS start_date FROM walk WHERE start_day IS NOT NULL")
def _(spark, d):
    days = windows.participant_days(stages.quality(spark, d))
    starts = windows.greedy_windows(F.col("valid_days"))
    return days.select("participant_id", F.explode(starts).alias("s")).select(
        "participant_id", F.date_from_unix_date("s").alias("start_date")
    )


@query(
    "w04_window_days",
    f"""SELECT participant_id, start_date, {DAYS_TEXT.format(c='days')} AS days, len(days) AS n_days FROM win""",
)
def _(spark, d):
    out = windows.windows(stages.quality(spark, d))
    return out.select(
        "participant_id",
        "start_date",
        _text(F.col("days")).alias("days"),
        F.size("days").cast("long").alias("n_days"),
    )


@query(
    "w05_window_table",
    """SELECT participant_id, start_date, end_date,
strftime(start_date, '%Y-%m-%d') || '_' || strftime(end_date, '%Y-%m-%d') AS time_range FROM win""",
)
def _(spark, d):
    out = windows.windows(stages.quality(spark, d))
    return out.select("participant_id", "start_date", "end_date", windows.time_range().alias("time_range"))


@query(
    "w06_has_window",
    """SELECT participant_id, bool_or(first_day + 9 <= last_day AND n >= 9) AS has_window
FROM (SELECT b.participant_id, b.day AS first_day, b.last_day, count(q.date) AS n
  FROM (SELECT participant_id, last_day, unnest(generate_series(first_day, last_day, INTERVAL 1 DAY))::DATE AS day
        FROM (SELECT participant_id, min(date) AS first_day, max(date) AS last_day FROM quality GROUP BY ALL)) b
  LEFT JOIN quality q ON q.participant_id = b.participant_id AND q.date BETWEEN b.day AND b.day + 9
  GROUP BY ALL) GROUP BY participant_id""",
)
def _(spark, d):
    days = windows.participant_days(stages.quality(spark, d))
    return days.select("participant_id", windows.has_window(F.col("days"), 10, 1).alias("has_window"))


@query("w07_qualifying_participants", WINDOW_FLAGS_SQL)
def _(spark, d):
    return windows.qualifying_participants(stages.quality(spark, d))
