"""Session checks, the shared folder and tables stored in it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_stored: dict[tuple[str, str, str, str], str] = {}


def pin_session(spark: SparkSession) -> SparkSession:
    """Local time is kept in TIMESTAMP_NTZ; arithmetic on it needs a session zone without DST."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.removeprefix("Etc/") not in ("UTC", "UCT", "GMT", "GMT0", "Z", "Zulu", "Universal", "Greenwich", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC; it is {zone}")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir``; where that is unset, a folder in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one run under the shared folder."""
    return f"{shared_folder(spark)}/daygrid/{name}-{uuid.uuid4().hex}"


def source_state(spark: SparkSession, folder: str) -> str:
    """Digest of the files below ``folder``: paths, sizes and times of change, not contents."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .selectExpr("path", "length", "unix_micros(modificationTime) AS changed")
    )
    listed = sorted(tuple(r) for r in files.collect())
    return hashlib.sha256(repr(listed).encode()).hexdigest()


def stored_stage(
    spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], partition: str | None = None
) -> DataFrame:
    """A table that is written once per application and state of its input folder, and read by every later job."""
    pin_session(spark)
    key = (spark.sparkContext.applicationId, folder, source_state(spark, folder), name)
    if key not in _stored:
        path = scratch_path(spark, name)
        writer = build().write
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])
