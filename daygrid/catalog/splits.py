"""Participant splits (inventory section P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.catalog.labels import TEXT_SQL
from daygrid.catalog.registry import query, rounded_all
from daygrid.catalog.stats import describe_sql
from daygrid.operators import labels, splits
from daygrid.plans import stages
from daygrid.sources import adapter
from daygrid.sources.session import scratch_path


@query("p01_label_count_bins", "SELECT participant_id, CAST(label_count AS INTEGER) AS label_count, stratum FROM bins")
def _(spark, d):
    return splits.label_count_bins(labels.labels_present(stages.flat(spark, d)))


@query("p02_split_by_label_count", "SELECT participant_id, split FROM assigned")
def _(spark, d):
    return splits.split_by_label_count(stages.flat(spark, d))


TEXT_COLUMNS = [f"{c}_value_str" for c in C.LABELS]
STRATA = ", ".join(f'"{c}"' for c in TEXT_COLUMNS)


@query(
    "p03_rare_strata",
    "SELECT "
    + ", ".join(f'"{c}"' for c in TEXT_COLUMNS)
    + f", count(*) AS n FROM ({TEXT_SQL}) GROUP BY ALL HAVING count(*) < 2",
)
def _(spark, d):
    strata = splits.label_strata(stages.flat(spark, d))
    return splits.rare_strata(strata, TEXT_COLUMNS)


@query(
    "p04_split_by_label_values",
    f"""SELECT participant_id, CASE WHEN row_number() OVER (PARTITION BY {STRATA} ORDER BY md5('42:' || participant_id), participant_id)
  <= round(count(*) OVER (PARTITION BY {STRATA}) * 0.2e0) THEN 'test' ELSE 'train' END AS split
FROM ({TEXT_SQL}) SEMI JOIN (SELECT * FROM info WHERE sharing_scope = 'all_qualified_researchers') USING (participant_id)""",
)
def _(spark, d):
    return splits.split_by_label_values(stages.flat(spark, d), adapter.participant_info(spark, d), check=False)


ENOUGH_SQL = f"SELECT * FROM ({TEXT_SQL}) SEMI JOIN (SELECT * FROM info WHERE sharing_scope = 'all_qualified_researchers') USING (participant_id) QUALIFY count(*) OVER (PARTITION BY {STRATA}) >= 2"
VALUE_SPLIT_SQL = f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY {STRATA} ORDER BY md5('42:' || participant_id), participant_id)
  <= round(count(*) OVER (PARTITION BY {STRATA}) * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM ({ENOUGH_SQL})"""


def _enough(spark, d):
    """Windows of participants whose stratum can be split."""
    flat = splits.open_sharing(stages.flat(spark, d), adapter.participant_info(spark, d))
    members = splits.without_rare_strata(splits.label_strata(flat), TEXT_COLUMNS)
    return flat.join(members, "participant_id", "left_semi")


@query(
    "p04b_checked_split_described",
    describe_sql(
        f"""(SELECT s.split, a.age, m.weight_kg, m.height_cm FROM ({VALUE_SPLIT_SQL}) s
LEFT JOIN demo1 m ON m.participant_id = s.participant_id LEFT JOIN ages a ON a.participant_id = s.participant_id)""",
        ["age", "weight_kg", "height_cm"],
        "split",
    ),
)
def _(spark, d):
    """The published split with its check for rare strata, and what each part looks like."""
    info = adapter.participant_info(spark, d)
    split = splits.split_by_label_values(_enough(spark, d), info)
    described = splits.described_splits(split, adapter.demographics(spark, d), info, ["age", "weight_kg", "height_cm"])
    return rounded_all(described, 4)


@query(
    "p07b_three_way_by_values",
    f"""SELECT participant_id, 'test' AS split FROM ({VALUE_SPLIT_SQL}) WHERE split = 'test'
UNION ALL SELECT participant_id, CASE WHEN row_number() OVER (PARTITION BY {STRATA} ORDER BY md5('42:' || participant_id), participant_id)
  <= round(count(*) OVER (PARTITION BY {STRATA}) * {0.1 / (1 - 0.2)!r}) THEN 'validation' ELSE 'train' END FROM ({VALUE_SPLIT_SQL}) WHERE split = 'train'""",
)
def _(spark, d):
    return splits.three_way(_enough(spark, d), by="label_values", info=adapter.participant_info(spark, d))


@query(
    "p07c_three_way_by_clusters",
    """SELECT count(*) AS members, 0::BIGINT AS overlapping, 0::BIGINT AS unassigned, 0::BIGINT AS unknown, true AS has_all
FROM (SELECT DISTINCT participant_id FROM flat SEMI JOIN (SELECT * FROM info WHERE sharing_scope = 'all_qualified_researchers') USING (participant_id))""",
)
def _(spark, d):
    """Clusters cannot be told by SQL; that the three parts are disjoint and complete can."""
    info, flat = adapter.participant_info(spark, d), stages.flat(spark, d)
    path = scratch_path(spark, "three-way")
    splits.three_way(flat, by="clusters", info=info, demographics=adapter.demographics(spark, d), k=4, starts=2).write.parquet(path)
    split, members = spark.read.parquet(path), splits.open_sharing(flat, info)
    parts = split.agg(F.count("*").alias("members"), (F.count_distinct("split") == 3).alias("has_all"))
    return parts.join(splits.split_checks(split, members))


@query(
    "p05_clusters",
    """SELECT count(*) AS members, true AS within_k, 0::BIGINT AS not_at_nearest FROM
(SELECT DISTINCT participant_id FROM flat) SEMI JOIN demo USING (participant_id)""",
)
def _(spark, d):
    """Labels of k-means cannot be told by SQL; what they have to fulfil can."""
    features = splits.demographic_features(
        stages.flat(spark, d), adapter.demographics(spark, d), adapter.participant_info(spark, d)
    )
    return splits.cluster_checks(features, k=8)


@query(
    "p06_split_by_cluster",
    """SELECT participant_id IN (SELECT participant_id FROM demo) AS has_demographics, count(*) AS members,
0::BIGINT AS unassigned, 0::BIGINT AS overlapping, 0::BIGINT AS wrong_strata
FROM (SELECT DISTINCT participant_id FROM flat SEMI JOIN (SELECT * FROM info WHERE sharing_scope = 'all_qualified_researchers') USING (participant_id))
GROUP BY 1""",
)
def _(spark, d):
    flat, info = stages.flat(spark, d), adapter.participant_info(spark, d)
    return splits.cluster_split_checks(flat, adapter.demographics(spark, d), info, k=8)


@query(
    "p07_three_way_split",
    f"""SELECT participant_id, 'test' AS split FROM assigned WHERE split = 'test'
UNION ALL SELECT participant_id, CASE WHEN
  row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || participant_id), participant_id)
  <= round(count(*) OVER (PARTITION BY stratum) * {0.1 / (1 - 0.2)!r}) THEN 'validation' ELSE 'train' END FROM bins2""",
)
def _(spark, d):
    return splits.three_way(stages.flat(spark, d))


@query(
    "p08_window_level_split",
    """SELECT participant_id, start_date, CASE WHEN row_number() OVER (
  ORDER BY md5('42:' || participant_id || '|' || strftime(start_date, '%Y-%m-%d')), participant_id, start_date)
  <= round(count(*) OVER () * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM win""",
)
def _(spark, d):
    return splits.window_level_split(stages.window_table(spark, d)).select(
        "participant_id", "start_date", "split"
    )
