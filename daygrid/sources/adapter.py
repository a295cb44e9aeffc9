"""Maps the driver's tables onto the record, label and participant schemas.

``events`` becomes the interval records of all four modalities; each rule is arithmetic on
``event_id``, so the same records can be derived by any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import time as T
from daygrid.operators.days import tasks_of
from daygrid.sources.session import pin_session, stored_stage

UNITS = ["m", "ft", "km", "mi", "cm", "in", "lb", "g", "mph", "fl_oz", "cal", "count/s"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval records of all modalities and participants, one union table.

    Stored once: the rules that derive the records would otherwise be repeated in every later predicate, which exceeds
    the size of one generated method. Readers of the stored table prune columns and push filters down. Its rows are dealt
    evenly, as the source file may have few row groups, which few tasks would read.
    """

    def build():
        derived = derived_records(spark, sf_dir)
        return derived.repartition(tasks_of(derived), "record_id")

    return stored_stage(spark, sf_dir, "records", build)


def derived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = F.col("event_id")
    last_digit = e % 10
    modality = (
        F.when(last_digit == 6, C.WORKOUT)
        .when(last_digit == 7, C.SLEEP)
        .when(last_digit >= 8, C.MOTION)
        .otherwise(C.QUANTITY)
    )
    quantity_type = (
        F.when(e % 11 == 0, C.STAND_TIME)
        .when(F.col("event_type") == "click", C.STEP_COUNT)
        .when(F.col("event_type") == "view", C.DISTANCE_WALKING_RUNNING)
        .when(F.col("event_type") == "purchase", C.ACTIVE_ENERGY)
        .when(F.col("event_type") == "signup", C.DISTANCE_CYCLING)
        .otherwise(C.HEART_RATE)
    )
    duration = (
        F.when(e % 101 == 0, F.lit(-10))
        .when(e % 103 == 0, F.lit(90000))
        .when(e % 17 == 0, F.lit(20000))
        .when(e % 7 == 1, F.lit(0))
        .otherwise(F.floor(F.col("value") * 60))
        .cast("long")
    )
    df = (
        events.withColumn("modality", modality)
        .withColumn("_q", quantity_type)
        .withColumn("_dur", duration)
        .withColumn("_start", T.to_micros(F.col("ts")))
        .withColumn("_start_offset", (((e % 7) - 3) * 60).cast("int"))
    )
    is_quantity = F.col("modality") == C.QUANTITY
    value = (
        F.when(F.col("modality") == C.SLEEP, F.col("_dur").cast("double"))
        .when(is_quantity & (F.col("_q") == C.STAND_TIME), (e % 40) * F.lit(0.001))
        .when(is_quantity & (F.col("_q") == C.HEART_RATE), F.lit(0.3) + (e % 400) * F.lit(0.01))
        .when(is_quantity & (e % 17 == 0), F.lit(0.0))
        .otherwise(F.greatest(F.col("_dur"), F.lit(1)) * ((e * 7919) % 3000 - 100) / F.lit(100.0))
    )
    fields = [
        F.col("user_id").alias("participant_id"),
        F.col("event_id").alias("record_id"),
        F.col("modality").alias("modality"),
        F.when(is_quantity, F.col("_q"))
        .when(F.col("modality") == C.SLEEP, C.SLEEP_TYPE)
        .alias("type"),
        F.when(F.col("modality") == C.SLEEP, _pick(C.SLEEP_CATEGORIES, F.floor(e / 10) % 2)).alias(
            "category"
        ),
        F.when(F.col("modality") == C.WORKOUT, _pick(C.WORKOUT_TYPES, F.floor(e / 10) % 10)).alias(
            "workout_type"
        ),
        F.when(F.col("modality") == C.MOTION, _pick(C.MOTION_ACTIVITIES, e % 6)).alias("activity"),
        F.col("_start").alias("start_us"),
        (F.col("_start") + F.col("_dur") * T.SECOND).alias("end_us"),
        F.col("_start_offset").alias("start_offset"),
        (F.col("_start_offset") + F.when(e % 53 == 0, 60).otherwise(0)).cast("int").alias("end_offset"),
        F.when(F.col("modality") != C.MOTION, value).alias("value"),
        F.when(F.col("modality") == C.MOTION, (F.floor(e / 6) % 4) * F.lit(0.1)).alias("confidence"),
        _pick(UNITS, e % 12).alias("unit"),
        F.col("event_type").alias("source"),
        F.when(e % 4 == 0, F.concat(F.lit("org.other."), F.col("event_type")))
        .otherwise(F.concat(F.lit("com.apple.health."), F.col("event_type")))
        .alias("source_identifier"),
        (e % 3).cast("string").alias("app_version"),
    ]
    return df.select(F.inline(F.array(F.struct(*fields))))


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey answers, wide, from ``purchase`` events. ``seq`` is the input order."""
    e = F.col("event_id")
    answers = (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("participant_id"),
            F.col("ts").alias("created_on"),
            e.alias("seq"),
            F.when(e % 5 != 0, (e % 2).cast("double")).alias("sleep_diagnosis1"),
            F.when(e % 4 != 3, (e % 11).cast("double")).alias("happiness"),
            F.when(e % 3 == 0, "[1. 10.]").when(e % 3 == 1, "[]").alias("heart_disease"),
            F.when(e % 7 != 0, (e % 10).cast("double")).alias("feel_worthwhile1"),
            F.when(e % 6 != 0, (e % 9) + F.lit(0.5)).alias("feel_worthwhile2"),
            F.when(F.col("user_id") % 3 != 0, (e % 11).cast("double")).alias("feel_worthwhile3"),
            F.when(F.col("user_id") % 4 != 0, (e % 2).cast("double")).alias("Diabetes"),
            F.when(F.col("user_id") % 5 == 0, (e % 2).cast("double")).alias("Hypertension"),
        )
    )
    # Some participants leave every question open.
    kept = ["participant_id", "created_on", "seq"]
    answered = F.col("participant_id") % 13 != 4
    return answers.select(*kept, *[F.when(answered, F.col(c)).alias(c) for c in answers.columns if c not in kept])


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two rows per participant; the second row of every ninth has more NULLs."""
    customer = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 6 != 0)
    sex = (
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Male")
        .when(F.col("c_mktsegment").isin("AUTOMOBILE", "FURNITURE"), "Female")
        .alias("biological_sex")
    )
    base = customer.select(
        F.col("c_custkey").alias("participant_id"),
        sex,
        (F.lit(50.0) + F.col("c_acctbal") / 200).alias("weight_kg"),
        F.when(F.col("c_custkey") % 8 != 0, F.lit(145.0) + (F.col("c_custkey") * 7) % 65).alias(
            "height_cm"
        ),
        F.lit(0).alias("row_no"),
    )
    repeated = base.where(F.col("participant_id") % 9 == 0).select(
        "participant_id",
        "biological_sex",
        F.lit(None).cast("double").alias("weight_kg"),
        F.lit(None).cast("double").alias("height_cm"),
        F.lit(1).alias("row_no"),
    )
    return base.unionByName(repeated)


def participant_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("participant_id"),
        F.when(k % 20 == 19, "not a date")
        .otherwise(
            F.date_format(
                F.date_add(F.lit("1950-01-01").cast("date"), ((k * 97) % 18000).cast("int")), "yyyy-MM-dd"
            )
        )
        .alias("birthdate"),
        F.lit("2024-01-01 06:00:00").alias("created_on"),
        F.when(k % 3 == 0, "sponsors_and_partners")
        .otherwise(C.OPEN_SHARING_SCOPE)
        .alias("sharing_scope"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series per user and event type with a last-value forecast.

    ``sample_id`` is the user, ``channel_idx`` the event type in alphabetical order, a cell is
    (day_index, hour).
    """
    types = ["click", "error", "purchase", "signup", "view"]
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    cells = events.groupBy(
        F.col("user_id").alias("sample_id"),
        (F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type")) - 1)
        .cast("int")
        .alias("channel_idx"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day_index"),
        F.hour("ts").alias("hour"),
    ).agg(F.round(F.sum("value"), 2).alias("y"))
    w = Window.partitionBy("sample_id", "channel_idx").orderBy("day_index", "hour")
    return cells.withColumn("yhat", F.lag("y").over(w)).withColumn(
        "mask",
        F.when(F.col("sample_id") % 5 != F.col("hour") % 5, 1).otherwise(0),
    )


def vector_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` read as short days of one channel with an independent mask.

    Small components become zero (gaps); every cell with (position + vec_id) % 9 = 0 is masked.
    """
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return df.select(
        "vec_id",
        "label",
        F.transform(
            "embedding", lambda x: F.when(F.abs(x) < 0.06, F.lit(0.0)).otherwise(x.cast("double"))
        ).alias("values"),
        F.transform(
            "embedding",
            lambda x, i: F.when((i + F.col("vec_id")) % 9 == 0, F.lit(0)).otherwise(F.lit(1)),
        ).alias("mask"),
    )
