"""Readers and writers. Every reader takes all participants at once."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid import constants as C
from daygrid.functions import time as TM
from daygrid.operators import days
from daygrid.operators.grid import KEY
from daygrid.operators.windows import time_range
from daygrid.sources.session import scratch_path

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("participant_id", T.LongType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("modality", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("workout_type", T.StringType()),
        T.StructField("activity", T.StringType()),
        T.StructField("start_us", T.LongType()),
        T.StructField("end_us", T.LongType()),
        T.StructField("start_offset", T.IntegerType()),
        T.StructField("end_offset", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_identifier", T.StringType()),
        T.StructField("app_version", T.StringType()),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        return False
    return True


def participant_from_path(pattern: str = r"([^/]+)\.parquet$") -> Column:
    """Participant named by a file or folder of the path."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


# --- raw records --------------------------------------------------------------------------------------


def read_modality(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    participant_pattern: str | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Records of one modality. With a pattern the participant comes from each file's path, else the
    table is shared and has its own participant column.

    Unreadable files and a missing folder fail the read. With ``lenient`` they give no rows; ``skipped_files`` lists
    the files that are left out.
    """
    flag = "true" if lenient else "false"
    reader = (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", flag)
        .option("ignoreMissingFiles", flag)
        .option("recursiveFileLookup", "true")
    )
    if lenient and not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = reader.parquet(path)
    if participant_pattern is None:
        return df
    columns = [F.col(c) for c in df.columns if c != "participant_id"]
    participant = participant_from_path(participant_pattern).cast(schema["participant_id"].dataType)
    return df.select(participant.alias("participant_id"), *columns).select(*schema.names)


def skipped_files(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    """Files below ``path`` that a lenient read leaves out: those that give no row but are not empty tables."""
    if not exists(spark, path):
        return []
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = listed.where(F.col("path").endswith(".parquet") & (F.col("length") > 0)).select("path")
    read = read_modality(spark, path, schema, lenient=True).select(F.col("_metadata.file_path").alias("path")).distinct()
    empty = {r["path"] for r in listed.join(read, "path", "left_anti").collect()}

    def broken(file: str) -> bool:
        try:
            spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(file).write.format("noop").mode(
                "overwrite"
            ).save()
        except Exception:  # noqa: BLE001  whatever the reader objects to, the file was left out
            return True
        return False

    return sorted(f for f in empty if broken(f))


def with_micros(df: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Replace timestamp columns by ``start_us`` / ``end_us``."""
    out = df.withColumn("start_us", TM.to_micros(F.col(start))).drop(start)
    if end in df.columns:
        out = out.withColumn("end_us", TM.to_micros(F.col(end))).drop(end)
    return out


#: Rows of one participant in one file, at most on average.
PARTICIPANT_ROWS = 1_000_000


def by_participant(df: DataFrame) -> DataFrame:
    """Rows dealt so that a participant's are in one task, those of a large one in several: files follow participants, not
    tasks times participants."""
    large = df.groupBy(F.col("participant_id").alias("_p")).agg(F.ceil(F.count("*") / PARTICIPANT_ROWS).alias("_files"))
    files = F.coalesce("_files", F.lit(1))
    salted = df.join(large.where("_files > 1"), F.col("participant_id").eqNullSafe(F.col("_p")), "left")
    salt = F.pmod(F.xxhash64(*df.columns), files)
    return salted.repartition(days.tasks_of(df), "participant_id", salt).select(*df.columns)


def write_raw(df: DataFrame, path: str) -> None:
    """One folder per participant for quantity and motion, one shared table for workout and sleep."""
    for modality in C.MODALITIES:
        own = df.where(F.col("modality") == modality)
        target = f"{path}/{modality}"
        if modality in (C.QUANTITY, C.MOTION):
            by_participant(own).withColumn("user", F.col("participant_id")).drop("participant_id").write.partitionBy(
                "user"
            ).parquet(target)
        else:
            own.write.parquet(target)


FILE = ["path", "length", "changed"]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and time of change (microseconds) of the files below a folder; no file is opened."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    )
    return found.select("path", "length", F.unix_micros("modificationTime").alias("changed"))


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of all modalities from the given files."""
    return spark.read.schema(RECORD_SCHEMA).parquet(*paths)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    out = None
    for modality in C.MODALITIES:
        per_participant = modality in (C.QUANTITY, C.MOTION)
        df = read_modality(
            spark, f"{path}/{modality}", RECORD_SCHEMA, r"/user=([^/]+)/" if per_participant else None
        )
        out = df if out is None else out.unionByName(df)
    return out


def participants(df: DataFrame) -> DataFrame:
    return df.select("participant_id").distinct()


def in_range(df: DataFrame, first: str, last: str, participant_ids: list | None = None) -> DataFrame:
    """Records starting on ``first`` .. ``last`` (dates, both included), as a pushed-down range."""
    import datetime as dt

    def micros(day, plus):
        d = dt.date.fromisoformat(day) + dt.timedelta(days=plus)
        return (d - dt.date(1970, 1, 1)).days * TM.DAY

    out = df.where((F.col("start_us") >= micros(first, 0)) & (F.col("start_us") < micros(last, 1)))
    return out if participant_ids is None else out.where(F.col("participant_id").isin(*participant_ids))


# --- days and statistics ------------------------------------------------------------------------------


#: Files per date that one run writes, at most: participants are dealt into so many groups.
DAY_FILES = 8


def write_days(df: DataFrame, path: str, mode: str = "append", files: int = DAY_FILES) -> None:
    """Days as runs, one row per participant's day."""
    group = F.pmod(F.xxhash64("participant_id"), F.lit(files))
    df.repartition("date", group).write.mode(mode).partitionBy("date").parquet(path)


def replace_days(spark: SparkSession, new: DataFrame, gone: DataFrame, path: str) -> None:
    """Write ``new`` days in place of the stored ones of ``gone``: dates with either are rewritten, others untouched."""
    key = ["participant_id", "date"]
    dates = gone.select("date").unionByName(new.select("date")).distinct()
    kept = spark.read.parquet(path).join(dates, "date", "left_semi").join(gone, key, "left_anti")
    held = scratch_path(spark, "replaced-days")
    kept.unionByName(new).write.parquet(held)
    group = F.pmod(F.xxhash64("participant_id"), F.lit(DAY_FILES))
    rows = spark.read.schema(kept.schema).parquet(held).repartition("date", group)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def drop_keys(spark: SparkSession, gone: DataFrame, path: str) -> None:
    """Take the days of ``gone`` out of a stored statistics table."""
    if not exists(spark, path):
        return
    held = scratch_path(spark, "kept-stats")
    kept = spark.read.parquet(path).join(gone, ["participant_id", "date"], "left_anti")
    kept.write.parquet(held)
    write_day_stats(spark.read.schema(kept.schema).parquet(held), path, "overwrite")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """Stored days as runs; badly shaped ones are left out and become placeholders downstream. Row-local."""
    return spark.read.parquet(path).where(days.well_formed())


def write_day_stats(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def write_stats_per_participant(df: DataFrame, path: str) -> None:
    rows = by_participant(df).withColumn("user", F.col("participant_id")).drop("participant_id")
    rows.write.partitionBy("user").parquet(path)


def read_stats_per_participant(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Statistics of many participants; columns missing in older files are NULL."""
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    return df.withColumn("participant_id", participant_from_path(r"/user=([^/]+)/").cast(id_type))


# --- window manifests and labels ----------------------------------------------------------------------


def manifest(windows: DataFrame) -> DataFrame:
    """Text form: participant, time range, JSON list of day keys."""
    prefix = F.col("participant_id").cast("string")
    return windows.select(
        "participant_id",
        time_range().alias("time_range"),
        F.to_json(
            F.transform("days", lambda d: F.concat_ws("/", prefix, F.date_format(d, "yyyy-MM-dd")))
        ).alias("file_uris"),
    )


def write_manifest(windows: DataFrame, path: str) -> None:
    manifest(windows).write.option("header", "true").option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest with the day list parsed from its text (JSON or single-quoted list)."""
    df = (
        spark.read.schema("participant_id bigint, time_range string, file_uris string")
        .option("header", "true")
        .option("escape", '"')
        .csv(path)
    )
    return df.withColumn("file_uris", parse_uri_list(F.col("file_uris")))


def parse_uri_list(text: Column) -> Column:
    return F.from_json(F.translate(text, "'", '"'), "array<string>")


def windows_of_manifest(df: DataFrame) -> DataFrame:
    """Back to typed windows."""
    dates = F.split("time_range", "_")
    return df.select(
        "participant_id",
        F.get(dates, F.lit(0)).try_cast("date").alias("start_date"),
        F.get(dates, F.lit(1)).try_cast("date").alias("end_date"),
        F.transform("file_uris", lambda u: F.substring_index(u, "/", -1).try_cast("date")).alias("days"),
    )


def read_label_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Label table from CSV; a timestamp that cannot be read becomes NULL."""
    df = spark.read.schema(columns).option("header", "true").option("escape", '"').csv(path)
    return df.withColumn("created_on", F.try_to_timestamp("created_on").cast("timestamp_ntz"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


#: Series records in one row group; a reader holds the arrays of up to so many at once.
SERIES_IN_GROUP = 32


def write_series(df: DataFrame, path: str) -> None:
    """Series records. Repeated values take almost no space, so a row group bounded by bytes alone would hold thousands of
    records, which readers unpack by the thousand."""
    df.write.option("parquet.block.row.count.limit", str(SERIES_IN_GROUP)).parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Rows with a ``split`` column, one folder per split."""
    df.write.partitionBy("split").parquet(path)


# --- standardization parameters -----------------------------------------------------------------------


def write_standardization(params: DataFrame, path: str) -> None:
    """At most 24 rows, written as one file."""
    params.orderBy("feature_index").coalesce(1).write.option("header", "true").csv(path)


def read_standardization(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    df = (
        spark.read.schema("feature_index int, mean double, std_dev double").option("header", "true").csv(path)
    )
    return df if first is None else df.where(F.col("feature_index") < first)


def standardization_dict(params: DataFrame) -> dict[int, tuple[float, float]]:
    """Parameters as a mapping; one row per channel, 24 at most. A channel given twice is an error."""
    index = F.col("feature_index")
    per_channel = params.where((index >= 0) & (index < C.N_CHANNELS)).groupBy("feature_index").agg(
        F.count("*").alias("n"), F.max("mean").alias("mean"), F.max("std_dev").alias("std_dev")
    )
    rows = per_channel.collect()
    twice = sorted(r["feature_index"] for r in rows if r["n"] > 1)
    if twice:
        raise ValueError(f"standardization parameters given more than once for channels {twice}")
    return {r["feature_index"]: (r["mean"], r["std_dev"]) for r in rows}


# --- processed samples --------------------------------------------------------------------------------


def sample_key(
    kind: str, transforms: list[str], indices: list[int] | None, stats: dict | None, *inputs: str
) -> str:
    """Key of a processed sample table: everything that changes its content, also digests of the tables it reads."""
    text = json.dumps([kind, transforms, indices, sorted((stats or {}).items()), inputs])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def materialised(
    spark: SparkSession, folder: str, key: str, build, force: bool = False
) -> DataFrame:
    """Read the processed table of ``key``, building it first when absent or forced.

    A build goes to a folder of its own; the pointer to it is written last, so a run that dies leaves nothing that a
    later run takes for a table.
    """
    pointer = f"{folder}/{key}-pointer"
    if force or not exists(spark, pointer):
        path = f"{folder}/{key}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(pointer)
    return spark.read.parquet(spark.read.parquet(pointer).first()["path"])
