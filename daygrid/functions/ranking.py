"""Ranks over large groups without putting a group into one task.

A plain ``row_number() over (partition by g order by h)`` sends the whole group to one task. Here rows
are ordered by (bucket, order columns) where the bucket is a prefix of an md5 digest, so buckets are
even in size: rows are counted per bucket (partial aggregation), the counts are summed over at most
``16 ** digits`` buckets per group, and only the rows of one bucket meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_bucket(text: Column, digits: int = 3) -> Column:
    return F.substring(F.md5(text), 1, digits)


def bucketed_row_number(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "rank"
) -> DataFrame:
    """1-based rank within ``group`` by (bucket, order). ``order`` must be unique within a bucket."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    # Without group columns this window holds at most 16 ** digits rows.
    cumulative = Window.partitionBy(*group).orderBy("_bucket")
    offsets = counts.withColumn(
        "_before", F.sum("_n").over(cumulative.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ).drop("_n")
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    keys = [*group, "_bucket"]
    right = offsets.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_before")
    match = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return (
        df.withColumn("_within", F.row_number().over(within))
        .join(right, condition)
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_bucket", "_within", "_before", *[f"_r{i}" for i in range(len(keys))])
    )


def rank_and_size(df: DataFrame, group: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Add ``_rank`` (from 1, by bucket, then ``order``) and ``_size`` within ``group``.

    Rows move once, to their (group, bucket). A bucket's size is its last rank, so the bucket table comes from the same
    shuffle; it carries what lies before a bucket and the group's total, and moves twice: at most ``16 ** digits`` rows
    a group.
    """
    keys = ["_g", "_bucket"]
    rows = df.withColumns({"_g": F.struct(F.lit(0).alias("_all"), *group), "_bucket": bucket})
    rows = rows.withColumn("_within", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    table = rows.groupBy(*keys).agg(F.max("_within").alias("_n"))
    whole = Window.partitionBy("_g")
    so_far = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    table = table.select(*keys, (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    joined = rows.join(table, keys)
    return joined.withColumn("_rank", F.col("_before") + F.col("_within")).drop(*keys, "_within", "_before")
