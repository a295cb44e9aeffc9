"""Comparison of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_sets(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    left, right = set(a.columns), set(b.columns)
    return {
        "only_a": sorted(left - right),
        "only_b": sorted(right - left),
        "common": sorted(left & right),
    }


def profile(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Row count, rows beyond the first of identical rows, and NULLs per column."""
    identical = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    duplicates = identical.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        *[
            F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"nulls_{c}")
            for c in columns
        ],
    )
    return duplicates.select(F.lit(name).alias("dataset"), "*")


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table without a counterpart in the other, counting repetitions."""
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("only_b"))
    )


def column_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Per common column the number of keys whose values differ (both missing counts as equal)."""
    columns = [c for c in column_sets(a, b)["common"] if c != key]
    left = a.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = left.join(right, key, "full_outer")
    one = both.agg(
        *[F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns]
    )
    return one.unpivot([], columns, "column_name", "different")


def sample_differences(a: DataFrame, b: DataFrame, key: str, column: str, n: int = 3) -> DataFrame:
    """The first ``n`` differing keys of a column."""
    both = a.select(key, F.col(column).alias("a")).join(b.select(key, F.col(column).alias("b")), key)
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).orderBy(key).limit(n)
