"""Record cleaning and report helpers (inventory section F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.catalog.registry import query, rounded, rounded_all
from daygrid.catalog.sql import TYPE_OK, _in, rd
from daygrid.operators import clean, intervals, labels, samples, splits, stats, summary
from daygrid.plans import stages
from daygrid.sources import adapter

ID = ["record_id", "participant_id", "modality"]


@query("f01_unit_normalisation", f"SELECT record_id, unit, {rd('value', 4)} AS value FROM std")
def _(spark, d):
    df = clean.normalise_units(adapter.records(spark, d))
    return df.select("record_id", "unit", rounded("value", 4).alias("value"))


@query("f02_equal_offsets", "SELECT record_id FROM rec WHERE start_offset = end_offset")
def _(spark, d):
    df = adapter.records(spark, d)
    return df.where(clean.same_offset(df.columns)).select("record_id")


@query("f03_not_negative", "SELECT record_id FROM rec WHERE end_us >= start_us")
def _(spark, d):
    df = adapter.records(spark, d)
    return df.where(clean.not_negative(df.columns)).select("record_id")


@query("f04_not_too_long", "SELECT record_id FROM rec WHERE end_us - start_us <= 86400000000")
def _(spark, d):
    df = adapter.records(spark, d)
    return df.where(clean.not_too_long(df.columns)).select("record_id")


def _type_rule(name: str, record_type: str) -> None:
    sql = f"""SELECT record_id, {rd('value', 4)} AS value FROM timed
WHERE coalesce(type, '') <> '{record_type}' OR coalesce({TYPE_OK}, false)"""

    @query(name, sql)
    def _(spark, d):
        df = clean.normalise_units(adapter.records(spark, d))
        return clean.keep_plausible_type(df, record_type).select(
            "record_id", rounded("value", 4).alias("value")
        )


_type_rule("f05_step_rate", C.STEP_COUNT)
_type_rule("f06_energy_rate", C.ACTIVE_ENERGY)
_type_rule("f07_walking_running_rate", C.DISTANCE_WALKING_RUNNING)
_type_rule("f08_cycling_rate", C.DISTANCE_CYCLING)
_type_rule("f09_stand_time", C.STAND_TIME)
_type_rule("f10_heart_rate", C.HEART_RATE)


@query(
    "f09b_stand_time_rate_only",
    f"""SELECT record_id FROM timed WHERE coalesce(type, '') <> '{C.STAND_TIME}'
OR coalesce(value >= 0 AND d <> 0 AND value * 60 / nullif(d, 0) <= 1, false)""",
)
def _(spark, d):
    df = clean.normalise_units(adapter.records(spark, d))
    return clean.keep_plausible_type(df, C.STAND_TIME, compat=False).select("record_id")


@query(
    "f11_filter_chain",
    f"SELECT record_id, participant_id, modality, unit, {rd('value', 4)} AS value FROM clean",
)
def _(spark, d):
    df = clean.keep_plausible(clean.normalise_units(adapter.records(spark, d)))
    return df.select(*ID, "unit", rounded("value", 4).alias("value"))


@query("f11b_filter_chain_by_modality", "SELECT record_id, modality FROM clean")
def _(spark, d):
    df = clean.normalise_units(adapter.records(spark, d))
    out = None
    for modality in C.MODALITIES:
        one = clean.keep_plausible(df.where(F.col("modality") == modality), modality)
        out = one if out is None else out.unionByName(one)
    return out.select("record_id", "modality")


@query(
    "f12_local_time",
    """SELECT record_id, start_us + start_offset * 60000000::BIGINT AS start_us,
CASE modality WHEN 'motion' THEN end_us + start_offset * 60000000::BIGINT WHEN 'sleep' THEN end_us
  ELSE end_us + end_offset * 60000000::BIGINT END AS end_us FROM rec""",
)
def _(spark, d):
    return clean.to_local_time(adapter.records(spark, d)).select("record_id", "start_us", "end_us")


@query(
    "f13_local_time_generic",
    """SELECT record_id, start_us + start_offset * 60000000::BIGINT AS start_us,
end_us + end_offset * 60000000::BIGINT AS end_us FROM rec""",
)
def _(spark, d):
    return clean.to_local_time_generic(adapter.records(spark, d)).select("record_id", "start_us", "end_us")


@query(
    "f14_sleep_end",
    """SELECT record_id, start_us, start_us + CAST(round(value * 1e6) AS BIGINT) AS end_us
FROM rec WHERE modality = 'sleep'""",
)
def _(spark, d):
    df = adapter.records(spark, d).where(F.col("modality") == C.SLEEP)
    return clean.sleep_end_from_duration(df).select("record_id", "start_us", "end_us")


@query("f15_skip_modalities", "SELECT record_id, modality FROM rec WHERE modality NOT IN ('sleep', 'motion')")
def _(spark, d):
    return clean.without_modalities(adapter.records(spark, d), [C.SLEEP, C.MOTION]).select(
        "record_id", "modality"
    )


@query(
    "f16_channel_selection",
    f"""SELECT participant_id, date, feature_index,
CAST(CASE feature_index WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 2 ELSE 3 END AS INTEGER) AS position,
{rd('data_coverage')} AS data_coverage FROM stats WHERE feature_index IN (0, 2, 5, 16)""",
)
def _(spark, d):
    df = samples.select_channels(stages.day_stats(spark, d), [5, 0, 16, 2, 2], "feature_index")
    return rounded_all(df.select("participant_id", "date", "feature_index", "position", "data_coverage"))


@query(
    "f17_windows_with_label",
    "SELECT participant_id, start_date, feel_worthwhile3_value FROM flat WHERE feel_worthwhile3_value IS NOT NULL",
)
def _(spark, d):
    return labels.with_label(stages.flat(spark, d), "feel_worthwhile3").select(
        "participant_id", "start_date", "feel_worthwhile3_value"
    )


@query(
    "f18_valid_samples",
    "SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 5 <> 3",
)
def _(spark, d):
    df = adapter.vector_days(spark, d).select(
        "vec_id",
        "label",
        F.when(
            F.col("vec_id") % 7 == 0,
            F.transform("values", lambda v, i: F.when(i == 3, F.lit(float("nan"))).otherwise(v)),
        )
        .when(F.col("vec_id") % 11 != 0, F.col("values"))
        .alias("x"),
        F.when(F.col("vec_id") % 5 != 3, F.col("mask").cast("array<double>")).alias("y"),
    )
    return samples.valid_samples(df, "x", "y").select("vec_id", "label")


@query(
    "f19_test_rows_or_all",
    """SELECT 'with test rows' AS which, event_id FROM events WHERE user_id % 5 = 0
UNION ALL SELECT 'without test rows', event_id FROM events""",
)
def _(spark, d):
    events = adapter.table(spark, d, "events").select("event_id", "user_id")
    marked = events.withColumn("split", F.when(F.col("user_id") % 5 == 0, "test").otherwise("train"))
    unmarked = events.withColumn("split", F.lit("train"))
    out = [
        splits.evaluation_rows(df).select(F.lit(name).alias("which"), "event_id")
        for name, df in (("with test rows", marked), ("without test rows", unmarked))
    ]
    return out[0].unionByName(out[1])


@query(
    "f20_default_categories",
    f"""SELECT record_id, CASE WHEN modality = 'workout' THEN CASE WHEN record_id % 3 = 0
 THEN 'HKWorkoutActivityTypeOther' ELSE workout_type END END AS workout_type,
CASE WHEN modality = 'motion' THEN CASE WHEN record_id % 4 = 0 THEN 'not available' ELSE activity END END AS activity
FROM rec""",
)
def _(spark, d):
    df = adapter.records(spark, d).withColumns(
        {
            "workout_type": F.when(F.col("record_id") % 3 == 0, "Swimming").otherwise(F.col("workout_type")),
            "activity": F.when(F.col("record_id") % 4 != 0, F.col("activity")),
        }
    )
    return clean.with_default_categories(df).select("record_id", "workout_type", "activity")


@query(
    "f21_clipped_rates",
    f"""SELECT record_id, type, {rd('''least(greatest(
  value * CASE WHEN type = '%s' THEN 60 ELSE 1 END / ((end_us - start_us) / 1e6), 0),
  CASE type WHEN '%s' THEN 5 WHEN '%s' THEN 250 WHEN '%s' THEN 3 WHEN '%s' THEN 10 ELSE 1 END)'''
        % (C.STAND_TIME, C.STEP_COUNT, C.ACTIVE_ENERGY, C.DISTANCE_WALKING_RUNNING, C.DISTANCE_CYCLING))} AS rate
FROM locd WHERE type IN {_in([t for t in C.QUANTITY_TYPES if t != C.HEART_RATE])} AND end_us <> start_us""",
)
def _(spark, d):
    df = clean.clipped_rates(clean.report_units(stages.local_records(spark, d)))
    return df.select("record_id", "type", rounded("rate").alias("rate"))


@query(
    "f22_report_units",
    f"""SELECT record_id, CAST((start_us % 86400000000) // 1000000 AS INTEGER) AS second_of_day,
{rd(f"value * CASE WHEN type IN ('{C.HEART_RATE}', '{C.STAND_TIME}') THEN 60 ELSE 1 END", 4)} AS value FROM locd""",
)
def _(spark, d):
    df = clean.report_units(stages.local_records(spark, d))
    return df.select("record_id", "second_of_day", rounded("value", 4).alias("value"))


@query(
    "f23_first_complete_day",
    """SELECT participant_id, coalesce(min(date) FILTER (n = kinds), min(date) FILTER (q)) AS date
FROM (SELECT participant_id, date, count(DISTINCT modality) AS n, bool_or(modality = 'healthkit') AS q
      FROM locd WHERE modality <> 'motion' GROUP BY ALL)
JOIN (SELECT participant_id, count(DISTINCT modality) AS kinds, bool_or(modality = 'healthkit') AS anyq
      FROM locd WHERE modality <> 'motion' GROUP BY ALL) USING (participant_id)
WHERE anyq GROUP BY participant_id""",
)
def _(spark, d):
    return summary.first_complete_day(stages.local_records(spark, d))


@query(
    "f23b_records_of_first_day",
    """SELECT l.record_id, l.participant_id, l.date FROM locd l JOIN (
SELECT participant_id, coalesce(min(date) FILTER (n = kinds), min(date) FILTER (q)) AS date
FROM (SELECT participant_id, date, count(DISTINCT modality) AS n, bool_or(modality = 'healthkit') AS q
      FROM locd WHERE modality <> 'motion' GROUP BY ALL)
JOIN (SELECT participant_id, count(DISTINCT modality) AS kinds, bool_or(modality = 'healthkit') AS anyq
      FROM locd WHERE modality <> 'motion' GROUP BY ALL) USING (participant_id)
WHERE anyq GROUP BY participant_id) f ON f.participant_id = l.participant_id AND f.date = l.date""",
)
def _(spark, d):
    return summary.records_of_first_day(stages.local_records(spark, d)).select(
        "record_id", "participant_id", "date"
    )
