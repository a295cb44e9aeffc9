"""Sources and sinks (inventory section S): each query writes to the shared scratch folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.catalog.export import SERIES_SQL, flat_samples, series_sums
from daygrid.catalog.labels import FLAT_SQL
from daygrid.catalog.registry import query, rounded, rounded_all
from daygrid.catalog.sql import rd
from daygrid.catalog.stats import STANDARD_SQL
from daygrid.functions import arrays as A
from daygrid.operators import days, export, labels, post, samples, splits
from daygrid.plans import stages
from daygrid.plans.incremental import build_days_from_files
from daygrid.sources import adapter, files
from daygrid.sources.session import scratch_path, source_state

RAW_SQL = f"""SELECT participant_id, record_id, modality, type, start_us, end_us, start_offset,
{rd('value', 4)} AS value FROM rec"""


@query("s01_read_raw_records", RAW_SQL)
def _(spark, d):
    path = scratch_path(spark, "raw")
    files.write_raw(adapter.records(spark, d), path)
    out = files.read_raw(spark, path)
    return rounded_all(
        out.select(
            "participant_id", "record_id", "modality", "type", "start_us", "end_us", "start_offset", "value"
        ),
        4,
    )


@query("s02_participants", "SELECT DISTINCT user_id AS participant_id FROM events")
def _(spark, d):
    return files.participants(adapter.records(spark, d))


STATS_SQL = f"""SELECT participant_id, date, feature_index, n, {rd('sum', 3)} AS sum FROM stats"""


def _stats(df):
    return df.select("participant_id", "date", "feature_index", "n", rounded("sum", 3).alias("sum"))


@query("s03_stats_per_participant", STATS_SQL)
def _(spark, d):
    path = scratch_path(spark, "stats_per_participant")
    files.write_stats_per_participant(stages.day_stats(spark, d), path)
    return _stats(files.read_stats_per_participant(spark, path))


@query(
    "s04_date_range",
    """SELECT record_id, participant_id FROM rec WHERE participant_id IN (1, 2, 3, 5, 8, 13)
AND start_us >= epoch_us(TIMESTAMP '2024-01-05') AND start_us < epoch_us(TIMESTAMP '2024-01-13')""",
)
def _(spark, d):
    path = scratch_path(spark, "records")
    adapter.records(spark, d).write.parquet(path)
    out = files.in_range(spark.read.parquet(path), "2024-01-05", "2024-01-12", [1, 2, 3, 5, 8, 13])
    return out.select("record_id", "participant_id")


DAYS_SQL = (
    """SELECT c.participant_id, c.date, CAST(c.channel_idx AS INTEGER) AS channel_idx,
CAST(count(m.value) AS INTEGER) AS observed,
"""
    + rd("coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE)), 0)", 3)
    + " AS total, "
    + rd("coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE) * (m.minute + 1)), 0)", 2)
    + """ AS weighted
FROM chanday c LEFT JOIN (SELECT * FROM minutes WHERE value <> 0) m ON m.participant_id = c.participant_id
  AND m.date = c.date AND m.channel_idx = c.channel_idx {where} GROUP BY c.participant_id, c.date, c.channel_idx"""
)


def _observed(df):
    """Values and mask of every cell, in sums that tell their places. Days of small files are dealt anew before they grow."""
    df = df.repartition(days.tasks_of(df))
    out = A.with_sums(days.expand(df), days.KEY, {"m": "mask", "v": "values"})
    observed = F.col("m.plain").cast("int").alias("observed")
    return out.select(*days.KEY, observed, rounded("v.total", 3).alias("total"), rounded("v.weighted", 2).alias("weighted"))


@query("s05_write_days", DAYS_SQL.format(where=""))
def _(spark, d):
    path = scratch_path(spark, "days")
    files.write_days(stages.day_runs(spark, d), path)
    return _observed(spark.read.parquet(path))


@query(
    "s06_read_days_checked",
    DAYS_SQL.format(where="WHERE c.participant_id % 10 NOT IN (3, 7)"),
)
def _(spark, d):
    """Days of some participants are damaged before they are written: a run past midnight, an unknown channel."""
    path = scratch_path(spark, "damaged_days")
    p = F.col("participant_id") % 10

    def more(channel, start, length):
        run = F.struct(F.lit(start).alias("start"), F.lit(length).alias("length"), F.lit(1.0).cast("float").alias("value"))
        return F.concat("channels", F.array(F.struct(F.lit(channel).alias("channel_idx"), F.array(run).alias("runs"))))

    broken = F.when(p == 3, more(23, 1400, 41)).when(p == 7, more(24, 0, 1)).otherwise(F.col("channels"))
    damaged = stages.day_runs(spark, d).withColumn("channels", broken)
    files.write_days(damaged, path)
    return _observed(files.read_days(spark, path))


@query("s07_write_day_stats", STATS_SQL)
def _(spark, d):
    path = scratch_path(spark, "day_stats")
    files.write_day_stats(stages.day_stats(spark, d), path)
    return _stats(spark.read.parquet(path))


MANIFEST_SQL = """SELECT participant_id, strftime(start_date, '%Y-%m-%d') || '_' || strftime(end_date, '%Y-%m-%d') AS time_range,
'["' || array_to_string([participant_id || '/' || strftime(x, '%Y-%m-%d') for x in days], '","') || '"]' AS file_uris FROM win"""


@query("s08_window_manifest", MANIFEST_SQL)
def _(spark, d):
    path = scratch_path(spark, "manifest")
    files.write_manifest(stages.window_table(spark, d), path)
    return (
        spark.read.schema("participant_id bigint, time_range string, file_uris string")
        .option("header", "true")
        .option("escape", '"')
        .csv(path)
    )


@query(
    "s09_nested_json",
    "SELECT participant_id, start_date, " + ", ".join(f'"{c}_value"' for c in C.LABELS) + " FROM flat",
)
def _(spark, d):
    path = scratch_path(spark, "nested")
    files.write_json(stages.labelled(spark, d), path)
    back = spark.read.schema(stages.labelled(spark, d).schema).json(path)
    return labels.flatten_labels(back).select(
        "participant_id", "start_date", *[f"{c}_value" for c in C.LABELS]
    )


@query("s10_flat_parquet", FLAT_SQL)
def _(spark, d):
    path = scratch_path(spark, "flat")
    stages.flat(spark, d).write.parquet(path)
    back = spark.read.parquet(path)
    return back.withColumns(
        {f"{c}_date": F.unix_micros(F.col(f"{c}_date").cast("timestamp")) for c in C.LABELS}
    ).drop("days")


@query(
    "s11_split_parquet",
    "SELECT w.participant_id, w.start_date, a.split FROM win w JOIN assigned a USING (participant_id)",
)
def _(spark, d):
    flat = stages.flat(spark, d)
    path = scratch_path(spark, "splits")
    files.write_splits(splits.rows_of_split(flat, splits.split_by_label_count(flat)), path)
    return spark.read.parquet(path).select("participant_id", "start_date", "split")


@query("s12_standardization_file", STANDARD_SQL.replace("FROM stats", "FROM stats WHERE feature_index < 8"))
def _(spark, d):
    path = scratch_path(spark, "standardization")
    files.write_standardization(stages.standardization(spark, d), path)
    out = files.read_standardization(spark, path, first=8)
    return out.select("feature_index", rounded("mean").alias("mean"), rounded("std_dev", 4).alias("std_dev"))


@query("s13_series_table", SERIES_SQL)
def _(spark, d):
    path = scratch_path(spark, "series")
    numbered = export.numbered_windows(stages.window_table(spark, d).drop("days"))
    files.write_series(export.series_records(flat_samples(spark, d), numbered, masked_as_nan=True), path)
    return series_sums(spark.read.parquet(path))


@query(
    "s14_incremental_days",
    f"""SELECT participant_id, date, feature_index, n, {rd('sum', 2)} AS sum, original_time_offset FROM stats""",
)
def _(spark, d):
    """A first run over files of half of the participants, a second when the others' are there, a third without new files."""
    source, records = scratch_path(spark, "inc_source"), adapter.records(spark, d)
    paths = [scratch_path(spark, f"inc_{name}") for name in ("days", "stats", "ledger")]
    for part in (0, 1, None):
        if part is not None:
            records.where(F.pmod("participant_id", F.lit(2)) == part).write.mode("append").parquet(source)
        taken = build_days_from_files(spark, source, *paths)
        if bool(taken) != (part is not None):
            raise AssertionError(f"files taken in: {taken}")
    out = spark.read.parquet(paths[1])
    return out.select(
        "participant_id", "date", "feature_index", "n", rounded("sum", 2).alias("sum"), "original_time_offset"
    )


@query(
    "s15_materialised_samples",
    """SELECT w.participant_id, w.start_date, w.day_index, CAST(c.channel_idx AS INTEGER) AS channel_idx,
CAST(count(m.value) AS INTEGER) AS observed
FROM wdays w CROSS JOIN (SELECT unnest([0, 5, 16]) AS channel_idx) c
LEFT JOIN (SELECT * FROM wmin WHERE value <> 0) m ON m.participant_id = w.participant_id
  AND m.start_date = w.start_date AND m.day_index = w.day_index AND m.channel_idx = c.channel_idx
GROUP BY w.participant_id, w.start_date, w.day_index, c.channel_idx""",
)
def _(spark, d):
    folder = scratch_path(spark, "samples")
    indices = [0, 5, 16]
    key = files.sample_key("window", ["masked_product"], indices, None, source_state(spark, d))

    def build():
        return samples.window_samples(
            stages.window_table(spark, d),
            stages.day_runs(spark, d),
            indices,
            postprocessors=[post.masked_product],
        )

    files.materialised(spark, folder, key, build)
    out = files.materialised(spark, folder, key, build)
    return out.select(
        "participant_id",
        "start_date",
        "day_index",
        "channel_idx",
        A.total("mask", kind="int").alias("observed"),
    )


@query(
    "s16_label_csv",
    """SELECT event_id AS seq, CASE WHEN event_id % 13 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 END AS created_s,
CASE WHEN user_id % 13 = 4 THEN NULL WHEN event_id % 3 = 0 THEN '[1. 10.]' WHEN event_id % 3 = 1 THEN '[]' END AS heart_disease
FROM events WHERE event_type = 'purchase'""",
)
def _(spark, d):
    path = scratch_path(spark, "label_csv")
    text = adapter.label_table(spark, d).select(
        "participant_id",
        F.when(F.col("seq") % 13 == 0, "soon")
        .otherwise(F.date_format("created_on", "yyyy-MM-dd HH:mm:ss"))
        .alias("created_on"),
        "seq",
        "heart_disease",
    )
    text.write.option("header", "true").option("escape", '"').csv(path)
    out = files.read_label_csv(
        spark, path, "participant_id bigint, created_on string, seq bigint, heart_disease string"
    )
    seconds = F.unix_micros(F.col("created_on").cast("timestamp")) / 1_000_000
    return out.select("seq", seconds.cast("bigint").alias("created_s"), "heart_disease")


@query(
    "s17_read_manifest",
    "SELECT participant_id, start_date, end_date, len(days) AS n_days, days[1] AS first_day FROM win",
)
def _(spark, d):
    path = scratch_path(spark, "manifest_back")
    files.write_manifest(stages.window_table(spark, d), path)
    out = files.windows_of_manifest(files.read_manifest(spark, path))
    return out.select(
        "participant_id",
        "start_date",
        "end_date",
        F.size("days").cast("bigint").alias("n_days"),
        F.get("days", F.lit(0)).alias("first_day"),
    )
