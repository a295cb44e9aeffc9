"""Narrowed histograms: awkward values, large groups, and how often the data is read."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.catalog import QUERIES
from daygrid.functions.quantiles import SIZE_BUCKET, summaries

SF = "/root/testdata/sf0.001"
P = [0.0, 0.25, 0.5, 0.9, 1.0]


def plain(values, p):
    x = sorted(v + 0.0 for v in values if v is not None and not math.isnan(v))
    at = (len(x) - 1) * p
    low, high = x[math.floor(at)], x[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize(
    "values",
    [
        [5.0], [0.0, -0.0, 0.0], [1e308, -1e308, 5e-324, -5e-324, 0.0], [float("-inf"), 1.0, 2.0, float("inf")],
        [1.0 + i * 2**-52 for i in range(50)], [None, math.nan, 3.0, None, 4.0], [-1.5] * 7 + [2.5] * 2,
        [math.exp(i / 7) * (-1) ** i for i in range(-400, 400)],
    ],
    ids=range(8),
)
def test_awkward_values(spark, values):
    df = spark.createDataFrame([("g", v, None) for v in values], "g string, x double, y double").repartition(3)
    rows = {r["variable"]: r for r in summaries(df, ["g"], ["x", "y"], P).collect()}
    assert str(rows["x"]["quantiles"]) == str([plain(values, p) for p in P])
    assert rows["x"]["n"] + rows["x"]["n_missing"] == len(values) == rows["y"]["n_missing"]
    assert rows["y"]["n"] == 0 and rows["y"]["quantiles"] == [None] * 5


def test_a_million_different_values_in_one_group(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 7_368_787, F.lit(1_000_003)) / 7 + 5).alias("x"))
    (row,) = summaries(df, ["g"], ["x"], [0.1, 0.5, 0.999]).collect()
    x = np.sort(np.array([r[0] for r in df.select("x").collect()]))
    assert len(set(x)) == 1_000_000
    assert row["quantiles"] == pytest.approx(np.quantile(x, [0.1, 0.5, 0.999]).tolist(), rel=1e-15)
    assert row["mean"] == pytest.approx(x.mean()) and row["m2"] == pytest.approx(((x - x.mean()) ** 2).sum())


def test_size_buckets_rise_with_values(spark):
    rng = np.random.default_rng(3)
    x = np.sort(np.concatenate([rng.standard_normal(2000) * 10.0 ** rng.integers(-300, 300, 2000), [0, np.inf, -np.inf]]))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = [r[0] for r in df.orderBy("v").selectExpr(SIZE_BUCKET).collect()]
    assert got == sorted(got)


def test_empty_table_and_too_many_groups(spark):
    assert summaries(spark.createDataFrame([], "g int, x double"), ["g"], ["x"], [0.5]).collect() == []
    with pytest.raises(Exception, match="more than 10000 groups"):
        summaries(spark.range(10_001).selectExpr("id AS g", "1.0 AS x"), ["g"], ["x"], [0.5]).collect()


def scans(df):
    """Scans of files in a plan and its subqueries, each counted once."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return len(re.findall(r"^\(\d+\) Scan parquet", text, re.M))


@pytest.mark.parametrize(("name", "sources"), [("a10_coverage_quantile", 1), ("c15_scaled_features", 4)])
def test_three_scans_and_no_nested_loops(spark, name, sources):
    df = QUERIES[name](spark, SF)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert scans(df) <= (3 + (name != "a10_coverage_quantile")) * sources
