"""Label joins, set operations and recoding (inventory sections J and C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.catalog.registry import query, rounded, rounded_all
from daygrid.catalog.sql import rd
from daygrid.operators import clean, compare, labels, recode, splits, summary
from daygrid.plans import stages
from daygrid.sources import adapter

FLAT_SQL = (
    "SELECT participant_id, start_date, end_date, "
    + ", ".join(f'"{c}_value", epoch_us("{c}_date") AS "{c}_date"' for c in C.LABELS)
    + " FROM flat"
)


def _plain(flat):
    micros = {f"{c}_date": F.unix_micros(F.col(f"{c}_date").cast("timestamp")) for c in C.LABELS}
    return flat.withColumns(micros).drop("days")


@query(
    "j01_nearest_label",
    "SELECT participant_id, start_date, end_date, label, label_value, epoch_us(label_date) AS label_date FROM match",
)
def _(spark, d):
    table = labels.prepare_labels(adapter.label_table(spark, d), C.LABELS)
    out = labels.nearest_label(stages.window_table(spark, d), labels.long_labels(table, C.LABELS))
    return out.withColumn("label_date", F.unix_micros(F.col("label_date").cast("timestamp")))


@query("j02_labelled_windows", FLAT_SQL)
def _(spark, d):
    nested = labels.labelled_windows(stages.window_table(spark, d), adapter.label_table(spark, d))
    return _plain(labels.flatten_labels(nested))


@query("j03_nested_and_flat", FLAT_SQL)
def _(spark, d):
    return _plain(labels.flatten_labels(labels.nest_labels(stages.flat(spark, d))))


@query(
    "j04_open_sharing",
    "SELECT participant_id, start_date FROM win SEMI JOIN (SELECT * FROM info WHERE sharing_scope = 'all_qualified_researchers') USING (participant_id)",
)
def _(spark, d):
    out = splits.open_sharing(stages.window_table(spark, d), adapter.participant_info(spark, d))
    return out.select("participant_id", "start_date")


AGE_CASE = """CASE WHEN age >= 65 THEN '65+' WHEN age >= 55 THEN '55-64' WHEN age >= 45 THEN '45-54'
WHEN age >= 35 THEN '35-44' WHEN age >= 25 THEN '25-34' WHEN age >= 18 THEN '18-24' ELSE 'Unknown_Age' END"""


@query(
    "j05_age_group",
    f"""SELECT e.participant_id, coalesce({AGE_CASE}, 'Unknown_Age') AS age_group
FROM (SELECT DISTINCT user_id AS participant_id FROM events) e
LEFT JOIN ages a USING (participant_id)""",
)
def _(spark, d):
    members = adapter.records(spark, d).select("participant_id").distinct()
    return splits.with_age_group(members, adapter.participant_info(spark, d))


@query(
    "j06_demographic_features",
    "SELECT m.participant_id, m.biological_sex, a.age, "
    + ", ".join(rd(f'f."{c}_value"') + f' AS "{c}_value"' for c in C.LABELS)
    + " FROM demo1 m LEFT JOIN ages a ON a.participant_id = m.participant_id JOIN (SELECT participant_id, "
    + ", ".join(f'avg("{c}_value") AS "{c}_value"' for c in C.LABELS)
    + " FROM flat GROUP BY participant_id) f ON f.participant_id = m.participant_id",
)
def _(spark, d):
    return rounded_all(
        splits.demographic_features(
            stages.flat(spark, d), adapter.demographics(spark, d), adapter.participant_info(spark, d)
        )
    )


@query(
    "j07_diagnostics",
    f"""SELECT coalesce(m.participant_id, a.participant_id) AS participant_id, m.biological_sex,
{rd('m.weight_kg', 4)} AS weight_kg, {rd('m.height_cm', 4)} AS height_cm, a.age
FROM demo1 m FULL JOIN ages a ON a.participant_id = m.participant_id""",
)
def _(spark, d):
    return rounded_all(splits.diagnostics(adapter.demographics(spark, d), adapter.participant_info(spark, d)), 4)


@query(
    "j08_demographics_coverage",
    """SELECT DISTINCT participant_id, participant_id IN (SELECT participant_id FROM demo) AS has_demographics FROM win""",
)
def _(spark, d):
    return splits.demographics_coverage(stages.window_table(spark, d), adapter.demographics(spark, d))


@query(
    "j09_split_checks",
    """SELECT count(*) FILTER (n > 1) AS overlapping, count(*) FILTER (n IS NULL) AS unassigned,
count(*) FILTER (m IS NULL) AS unknown
FROM (SELECT DISTINCT user_id AS m FROM events) e
FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS n FROM customer) a ON a.c_custkey = e.m""",
)
def _(spark, d):
    customers = adapter.table(spark, d, "customer").select(F.col("c_custkey").alias("participant_id"))
    assignment = customers.withColumn("split", F.lit("train")).unionByName(
        customers.where(F.col("participant_id") % 7 == 0).withColumn("split", F.lit("test"))
    )
    members = adapter.table(spark, d, "events").select(F.col("user_id").alias("participant_id"))
    return splits.split_checks(assignment, members)


@query(
    "j10_rows_of_split",
    "SELECT record_id, participant_id FROM rec WHERE participant_id % 5 = 0",
)
def _(spark, d):
    assignment = adapter.table(spark, d, "customer").select(
        F.col("c_custkey").alias("participant_id"),
        F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    rows = splits.rows_of_split(adapter.records(spark, d), assignment, "test")
    return rows.select("record_id", "participant_id")


def _altered(orders):
    changed = F.col("o_orderkey") % 100 == 0
    return orders.withColumns(
        {
            "o_totalprice": F.when(changed, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
            "o_orderstatus": F.when(F.col("o_orderkey") % 250 != 0, F.col("o_orderstatus")),
        }
    )


ALTERED_SQL = """(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 250 <> 0 THEN o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders)"""
ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)"


def _orders(spark, d):
    return adapter.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    "j11_row_differences",
    f"""SELECT *, 'only_a' AS side FROM ({ORDERS} EXCEPT ALL {ALTERED_SQL})
UNION ALL SELECT *, 'only_b' FROM ({ALTERED_SQL} EXCEPT ALL {ORDERS})""",
)
def _(spark, d):
    a = _orders(spark, d)
    return compare.row_differences(a, _altered(a))


@query(
    "j11b_column_differences",
    f"""SELECT 'o_custkey' AS column_name, count(*) FILTER (a.o_custkey IS DISTINCT FROM b.o_custkey) AS different
FROM {ORDERS} a FULL JOIN {ALTERED_SQL} b USING (o_orderkey)
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus)
FROM {ORDERS} a FULL JOIN {ALTERED_SQL} b USING (o_orderkey)
UNION ALL SELECT 'o_totalprice', count(*) FILTER (a.o_totalprice IS DISTINCT FROM b.o_totalprice)
FROM {ORDERS} a FULL JOIN {ALTERED_SQL} b USING (o_orderkey)""",
)
def _(spark, d):
    a = _orders(spark, d)
    return compare.column_differences(a, _altered(a), "o_orderkey")


@query(
    "j11c_profiles",
    f"""SELECT 'a' AS dataset, count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {ORDERS})) AS duplicate_rows,
count(*) FILTER (o_custkey IS NULL) AS nulls_o_custkey, count(*) FILTER (o_orderstatus IS NULL) AS nulls_o_orderstatus FROM {ORDERS}
UNION ALL SELECT 'b', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM {ALTERED_SQL})),
count(*) FILTER (o_custkey IS NULL), count(*) FILTER (o_orderstatus IS NULL) FROM {ALTERED_SQL}""",
)
def _(spark, d):
    a = _orders(spark, d)
    b = _altered(a).select("o_custkey", "o_orderstatus")
    left = compare.profile(a, a.columns, "a").select(
        "dataset", "rows", "duplicate_rows", "nulls_o_custkey", "nulls_o_orderstatus"
    )
    return left.unionByName(compare.profile(b, b.columns, "b"))


@query(
    "j11d_sample_of_differences",
    "SELECT o_orderkey, o_totalprice AS a, o_totalprice + 1 AS b FROM orders WHERE o_orderkey % 100 = 0 ORDER BY o_orderkey LIMIT 3",
)
def _(spark, d):
    a = _orders(spark, d)
    return compare.sample_differences(a, _altered(a), "o_orderkey", "o_totalprice")


@query(
    "j12_concatenate_modalities",
    "SELECT modality, count(*) AS n, CAST(sum(record_id) AS BIGINT) AS id_sum FROM rec GROUP BY modality",
)
def _(spark, d):
    df = adapter.records(spark, d).select("modality", "record_id")
    out = None
    for m in C.MODALITIES:
        one = df.where(F.col("modality") == m)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("modality").agg(F.count("*").alias("n"), F.sum("record_id").alias("id_sum"))


# --- C ------------------------------------------------------------------------------------------------

LIST_TEXTS = {
    0: "[1. 10.]",
    1: "[]",
    2: "[1, 2, 3]",
    3: " [ 4 ] ",
    4: "[1, 2 3]",
    5: "7",
    6: "abc",
    7: "[-1.5e1 +2]",
    8: "",
    9: "[a b]",
}
LIST_RESULTS = {0: "1.0,10.0", 1: "", 2: "1.0,2.0,3.0", 3: "4.0", 7: "-15.0,2.0"}


@query(
    "c01_parse_lists",
    "SELECT event_id, CASE event_id % 10 "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LIST_RESULTS.items())
    + " END AS numbers FROM events",
)
def _(spark, d):
    text = F.get(
        F.array(*[F.lit(LIST_TEXTS[k]) for k in range(10)]), (F.col("event_id") % 10).cast("int")
    )
    return adapter.table(spark, d, "events").select(
        "event_id", F.array_join(labels.parse_list(text).cast("array<string>"), ",").alias("numbers")
    )


@query(
    "c02_explode_list_labels",
    """SELECT seq, CAST(pos AS INTEGER) AS pos, v AS heart_disease FROM (
  SELECT seq, 0 AS pos, CASE WHEN heart_disease = '[1. 10.]' THEN 1e0 END AS v FROM lab0
  UNION ALL SELECT seq, 1, 1e1 FROM lab0 WHERE heart_disease = '[1. 10.]')""",
)
def _(spark, d):
    out = labels.explode_list_label(adapter.label_table(spark, d), "heart_disease")
    return out.select("seq", "pos", "heart_disease")


@query("c03_whole_labels", "SELECT event_id, trunc((event_id % 100 - 50) / 8e0) AS label FROM events")
def _(spark, d):
    value = (F.col("event_id") % 100 - 50) / F.lit(8.0)
    return adapter.table(spark, d, "events").select("event_id", labels.to_whole(value).alias("label"))


@query(
    "c04_default_label_columns",
    """SELECT label, pos, count(*) AS n FROM (SELECT label, pos FROM lab UNION ALL
  SELECT l.label, 1 FROM lab l JOIN lab0 a USING (seq) WHERE a.heart_disease = '[1. 10.]' AND l.label <> 'heart_disease')
GROUP BY label, pos""",
)
def _(spark, d):
    table = adapter.label_table(spark, d)
    names = labels.label_columns(table)
    long = labels.long_labels(labels.prepare_labels(table), names)
    return long.groupBy("label", "pos").agg(F.count("*").alias("n"))


@query("c05_age", "SELECT participant_id, age FROM ages")
def _(spark, d):
    return recode.with_age(adapter.participant_info(spark, d)).select("participant_id", "age")


FINE_AGE_CASE = AGE_CASE.replace("WHEN age >= 65 THEN '65+'", "WHEN age >= 75 THEN '75+' WHEN age >= 65 THEN '65-74'")


@query(
    "c06_age_groups",
    f"SELECT participant_id, {AGE_CASE} AS age_group, {FINE_AGE_CASE} AS age_group_fine FROM ages",
)
def _(spark, d):
    df = recode.with_age(adapter.participant_info(spark, d))
    return df.select(
        "participant_id",
        recode.age_group(F.col("age")).alias("age_group"),
        recode.age_group(F.col("age"), fine=True).alias("age_group_fine"),
    )


@query(
    "c07_weight_and_height_groups",
    """SELECT participant_id, row_no, CASE WHEN weight_kg >= 100 THEN '>100kg' WHEN weight_kg >= 90 THEN '90-100kg'
WHEN weight_kg >= 80 THEN '80-90kg' WHEN weight_kg >= 70 THEN '70-80kg' WHEN weight_kg >= 60 THEN '60-70kg'
WHEN weight_kg >= 50 THEN '50-60kg' WHEN weight_kg >= 0 THEN '<50kg' ELSE 'Unknown_Weight' END AS weight_group,
CASE WHEN height_cm >= 200 THEN '>200cm' WHEN height_cm >= 190 THEN '190-200cm' WHEN height_cm >= 180 THEN '180-190cm'
WHEN height_cm >= 170 THEN '170-180cm' WHEN height_cm >= 160 THEN '160-170cm' WHEN height_cm >= 150 THEN '150-160cm'
WHEN height_cm >= 0 THEN '<150cm' ELSE 'Unknown_Height' END AS height_group FROM demo""",
)
def _(spark, d):
    return adapter.demographics(spark, d).select(
        "participant_id",
        "row_no",
        recode.weight_group(F.col("weight_kg")).alias("weight_group"),
        recode.height_group(F.col("height_cm")).alias("height_group"),
    )


@query(
    "c08_most_complete_demographics",
    f"""SELECT participant_id, biological_sex, {rd('weight_kg', 4)} AS weight_kg, {rd('height_cm', 4)} AS height_cm,
row_no FROM demo QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY
 CAST(biological_sex IS NULL AS INT) + CAST(weight_kg IS NULL AS INT) + CAST(height_cm IS NULL AS INT), row_no) = 1""",
)
def _(spark, d):
    return rounded_all(recode.most_complete(adapter.demographics(spark, d)), 4)


@query("c09_duplicated_keys", "SELECT participant_id, row_no FROM demo WHERE participant_id % 9 = 0")
def _(spark, d):
    return recode.duplicated_rows(adapter.demographics(spark, d)).select("participant_id", "row_no")


COARSE = {
    "sleep_diagnosis1": "x",
    "happiness": "CASE WHEN x < 5 THEN 4 ELSE x END",
    "heart_disease": "CASE WHEN x IS NOT NULL AND x <> 10 THEN 0 ELSE x END",
    "feel_worthwhile1": "CASE WHEN x < 4 THEN 3 ELSE x END",
    "feel_worthwhile2": "CASE WHEN x < 4 THEN 3 ELSE x END",
    "feel_worthwhile3": "CASE WHEN x = 10 THEN 9 ELSE x END",
    "Diabetes": "x",
    "Hypertension": "x",
}
COARSE_SQL = (
    "SELECT participant_id, "
    + ", ".join(
        "CAST("
        + COARSE[c].replace("x", f'round_even(avg("{c}_value"), 0)')
        + f' AS INTEGER) AS "{c}_value"'
        for c in C.LABELS
    )
    + " FROM flat GROUP BY participant_id"
)


@query("c10_coarse_labels", COARSE_SQL)
def _(spark, d):
    return recode.coarse_means(labels.label_means(stages.flat(spark, d)))


TEXT = {
    "happiness": "CASE WHEN x IS NULL THEN 'Missing' WHEN x = 4 THEN '≤4 (Low)' ELSE x || ' (High)' END",
    "heart_disease": "CASE WHEN x IS NULL THEN 'Missing' WHEN x = 10 THEN '10' ELSE 'Other Heart Disease' END",
    "feel_worthwhile1": "CASE WHEN x IS NULL THEN 'Missing' WHEN x = 3 THEN '≤3 (Low)' ELSE x || ' (High)' END",
    "feel_worthwhile2": "CASE WHEN x IS NULL THEN 'Missing' WHEN x = 3 THEN '≤3 (Low)' ELSE x || ' (High)' END",
    "feel_worthwhile3": "CASE WHEN x IS NULL THEN 'Missing' WHEN x = 9 THEN '9-10 (High)' ELSE CAST(x AS VARCHAR) END",
}
PLAIN_TEXT = "coalesce(CAST(x AS VARCHAR), 'Missing')"
TEXT_SQL = (
    "SELECT participant_id, "
    + ", ".join(
        TEXT.get(c, PLAIN_TEXT).replace(" x ", f' "{c}_value" ').replace("(x ", f'("{c}_value" ')
        + f' AS "{c}_value_str"'
        for c in C.LABELS
    )
    + f" FROM ({COARSE_SQL})"
)


@query("c11_label_texts", TEXT_SQL)
def _(spark, d):
    return splits.label_strata(stages.flat(spark, d))


@query(
    "c12_dominant_app_version",
    """SELECT record_id, l.app_version FROM locd l JOIN (
SELECT participant_id, date, modality, type, app_version AS best FROM (
  SELECT participant_id, date, modality, type, app_version, count(*) AS n FROM locd GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY participant_id, date, modality, type ORDER BY n DESC, app_version) = 1) b
ON b.participant_id = l.participant_id AND b.date = l.date AND b.modality = l.modality
 AND b.type IS NOT DISTINCT FROM l.type WHERE l.app_version = b.best""",
)
def _(spark, d):
    out = recode.dominant_app_version(
        stages.local_records(spark, d), ["participant_id", "date", "modality", "type"]
    )
    return out.select("record_id", "app_version")


@query(
    "c13_device_classes",
    f"""SELECT participant_id, source, CASE
  WHEN bool_or(modality = 'healthkit' AND type = '{C.HEART_RATE}' AND source_identifier LIKE '%com.apple.health.%') THEN 'AppleWatch'
  WHEN bool_or(modality = 'healthkit' AND type <> '{C.HEART_RATE}' AND source_identifier LIKE '%com.apple.health.%') THEN 'iPhone'
  ELSE 'Unknown' END AS device FROM rec GROUP BY participant_id, source""",
)
def _(spark, d):
    return recode.device_classes(adapter.records(spark, d))


@query(
    "c14_top_devices",
    """SELECT * FROM (SELECT source AS device, count(*) AS n FROM locd GROUP BY source ORDER BY n DESC, device LIMIT 5)""",
)
def _(spark, d):
    return recode.top_devices(stages.local_records(spark, d).withColumnRenamed("source", "device"))


FEATURES = ["age", "weight_kg", "height_cm"]
SCALE_SQL = (
    "SELECT participant_id, coalesce(biological_sex, 'Missing') AS biological_sex, "
    + ", ".join(
        rd(f"({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END)")
        + f" AS {c}"
        for c in FEATURES
    )
    + " FROM (SELECT participant_id, biological_sex, "
    + ", ".join(f"coalesce(CAST({c} AS DOUBLE), quantile_cont({c}, 0.5) OVER ()) AS {c}"
        for c in FEATURES)
    + " FROM (SELECT m.*, a.age FROM demo1 m LEFT JOIN ages a USING (participant_id)))"
)


@query("c15_scaled_features", SCALE_SQL)
def _(spark, d):
    demo = recode.most_complete(adapter.demographics(spark, d)).drop("row_no")
    ages = recode.with_age(adapter.participant_info(spark, d)).select("participant_id", "age")
    return rounded_all(recode.scaled_features(demo.join(ages, "participant_id", "left"), FEATURES, "biological_sex"))
