"""Series export (inventory section X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.catalog.registry import query, rounded
from daygrid.catalog.sql import rd
from daygrid.functions import arrays as A
from daygrid.operators import export, samples
from daygrid.plans import stages

NUMBERED = """(SELECT *, row_number() OVER (ORDER BY substr(md5(CAST(participant_id AS VARCHAR)), 1, 3), participant_id, start_date) - 1
 AS row_number FROM win)"""


def flat_samples(spark, d):
    rows = samples.with_placeholders(stages.window_table(spark, d), stages.day_runs(spark, d), runs=True)
    return samples.flatten_days(samples.zero_missing(rows))


#: Targets in sums that tell channel and minute of each value.
SERIES_SQL = f"""SELECT w.participant_id || '_' || w.row_number AS item_id, epoch_us(w.start_date::TIMESTAMP) AS start_us, 'T' AS freq,
CAST(24 AS INTEGER) AS features, CAST(10080 AS INTEGER) AS length, CAST(24 * 10080 - count(m.value) AS INTEGER) AS n_nan,
{rd("coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE)), 0)", 3)} AS total,
{rd("coalesce(sum(CAST(CAST(m.value AS FLOAT) AS DOUBLE) * (m.channel_idx * 10080 + m.day_index * 1440 + m.minute + 1)), 0)", 0)} AS weighted
FROM {NUMBERED} w LEFT JOIN (SELECT * FROM wmin WHERE value <> 0) m ON m.participant_id = w.participant_id AND m.start_date = w.start_date
GROUP BY w.participant_id, w.row_number, w.start_date"""


def series_sums(records):
    """Sums over each record's whole target; channels are summed one by one, so a row holds one of them."""
    shape = {
        "start_us": F.unix_micros("start"),
        "features": F.size("target"),
        "length": F.size(F.get("target", F.lit(0))),
        "lengths": F.transform("target", lambda row: F.size(row)),
    }
    key = ["item_id", "start_us", "freq", "features", "length"]
    # Sizes are taken before, or every channel's row would carry the whole target.
    channels = records.withColumns(shape).select(*key, "lengths", F.posexplode_outer("target").alias("i", "values"))
    before = F.aggregate(F.slice("lengths", 1, F.col("i")), F.lit(0), lambda a, n: a + n)
    missing = F.size("values") - A.count_of_others("values", F.lit(float("nan")).cast("float"))
    parts = A.with_cell_sums(channels, [*key, before.alias("before"), missing.alias("n_nan")], "values")
    return parts.groupBy(*key).agg(
        F.sum("n_nan").cast("int").alias("n_nan"),
        rounded(F.sum("v.total"), 3).alias("total"),
        rounded(F.sum(F.col("v.weighted") + F.col("before") * F.col("v.total")), 0).alias("weighted"),
    )


@query("x01_series_records", SERIES_SQL)
def _(spark, d):
    numbered = export.numbered_windows(stages.window_table(spark, d).drop("days"))
    out = export.series_records(
        flat_samples(spark, d), numbered, masked_as_nan=True, include_mask=False
    )
    return series_sums(out)


@query(
    "x02_static_features",
    "SELECT participant_id, start_date, "
    + " || ',' || ".join(f"coalesce(CAST(\"{c}_value\" AS VARCHAR), 'NaN')" for c in sorted(C.LABELS))
    + " AS feat_static_real FROM flat",
)
def _(spark, d):
    flat = stages.flat(spark, d)
    features = export.static_features([f"{c}_value" for c in C.LABELS])
    return flat.select(
        "participant_id",
        "start_date",
        F.array_join(features.cast("array<string>"), ",").alias("feat_static_real"),
    )


@query(
    "x03_dynamic_features",
    """SELECT w.participant_id, w.start_date, CAST(24 AS INTEGER) AS features, CAST(count(m.value) AS INTEGER) AS observed
FROM win w LEFT JOIN (SELECT * FROM wmin WHERE value <> 0) m ON m.participant_id = w.participant_id AND m.start_date = w.start_date
GROUP BY w.participant_id, w.start_date""",
)
def _(spark, d):
    numbered = export.numbered_windows(stages.window_table(spark, d).drop("days"))
    out = export.series_records(flat_samples(spark, d), numbered)
    out = out.withColumn("features", F.size("feat_dynamic_real"))
    rows = out.select("item_id", "start", "features", F.explode_outer("feat_dynamic_real").alias("m"))
    observed = rows.withColumn("observed", A.count_of_others("m", F.lit(0.0).cast("float")))
    return observed.groupBy("item_id", "start", "features").agg(F.sum("observed").cast("int").alias("observed")).select(
        F.substring_index("item_id", "_", 1).cast("bigint").alias("participant_id"),
        F.to_date("start").alias("start_date"),
        "features",
        "observed",
    )


@query(
    "x04_feature_count",
    """SELECT features, count(*) AS samples FROM (SELECT w.participant_id, w.start_date, count(DISTINCT m.channel_idx) AS features
FROM win w LEFT JOIN wmin m ON m.participant_id = w.participant_id AND m.start_date = w.start_date GROUP BY ALL) GROUP BY features""",
)
def _(spark, d):
    """Samples by the number of channels they have data of: placeholders are no data, so samples may be uneven."""
    rows = samples.sample_days(stages.window_table(spark, d), stages.day_runs(spark, d))
    return export.feature_count(rows.select(*samples.SAMPLE, F.explode_outer("channels.channel_idx").alias("channel_idx")))
