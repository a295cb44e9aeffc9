"""Ranks that carry their group's size, several cut points at once, and plans that stay small."""

import re

import pytest
from pyspark.sql import functions as F

from daygrid.catalog import QUERIES
from daygrid.functions.ranking import rank_and_size
from daygrid.operators import splits

SF = "/root/testdata/sf0.001"


def members(spark):
    """One stratum holds most members, one is NULL, one has a single member."""
    stratum = F.when(F.col("id") < 400, "hot").when(F.col("id") < 450, "b").when(F.col("id") == 450, "one")
    return spark.range(500).select(F.col("id").alias("participant_id"), stratum.alias("s"))


def test_rank_and_size(spark):
    rows = members(spark).withColumn("h", F.md5(F.col("participant_id").cast("string")))
    out = rank_and_size(rows, ["s"], F.substring("h", 1, 3), [F.col("h"), F.col("participant_id")]).collect()
    for name, size in (("hot", 400), ("b", 50), ("one", 1), (None, 49)):
        own = sorted((r["h"], r["participant_id"], r["_rank"], r["_size"]) for r in out if r["s"] == name)
        assert [(r[2], r[3]) for r in own] == [(k + 1, size) for k in range(size)]


def test_several_parts_on_one_ranking(spark):
    out = splits.stratified_assignment(members(spark), ["s"], shares=[("test", 0.2), ("validation", 0.1)])
    counts = {(r["s"], r["split"]): r["count"] for r in out.join(members(spark), "participant_id").groupBy("s", "split").count().collect()}
    assert counts[("hot", "test")] == 80 and counts[("hot", "validation")] == 40 and counts[("hot", "train")] == 280
    assert counts[("one", "train")] == 1 and sum(counts.values()) == 500
    two = splits.stratified_assignment(members(spark), ["s"], 0.2)
    assert {r[0] for r in two.where("split = 'test'").collect()} == {r[0] for r in out.where("split = 'test'").collect()}


def test_rare_strata_are_left_out(spark):
    kept = splits.without_rare_strata(members(spark), ["s"])
    assert kept.count() == 499 and kept.where("s = 'one'").count() == 0
    splits.require_no_rare_strata(kept, ["s"])


def test_unknown_strata_are_an_error(spark):
    with pytest.raises(ValueError, match="clusters"):
        splits.three_way(spark.range(1), by="age")


@pytest.mark.parametrize(("name", "exchanges", "scans"), [("p02_split_by_label_count", 7, 3), ("p07_three_way_split", 28, 10), ("a16_summary_by_kind", 10, 3)])
def test_planned_before_reuse(spark, name, exchanges, scans):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) <= exchanges and "NestedLoop" not in text
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) <= scans
