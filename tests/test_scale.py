"""What keeps large tables in bounds: files per participant, rows gathered in order, arrays of one value."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from daygrid.functions import arrays as A
from daygrid.operators import evaluate, post, samples
from daygrid.sources import files

NAN = float("nan")
D0 = dt.date(2024, 1, 1)
SAMPLE = "participant_id long, start_date date, end_date date, "


def plain(x):
    return [plain(v) for v in x] if isinstance(x, list) else "nan" if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("values", [[0.0] * 3, [NAN] * 3, [None] * 3, [], None, [1.0, NAN, None], [2.0, 2.0], [0.0, 3.0], [NAN, 1.0]])
def test_arrays_of_one_value_are_told_and_treated_alike(spark, values):
    df = spark.createDataFrame([(values,)], "x array<double>")

    def f(v):
        return A.nan_to(v, 5.0) + 1

    def g(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a)

    x = F.col("x")
    row = df.select(
        A.mapped("x", f), F.transform(x, f), A.zipped("x", "x", g), F.zip_with(x, x, g),
        A.total("x", f), F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v)), A.is_constant(x),
    ).first()
    assert plain(row[0]) == plain(row[1]) and plain(row[2]) == plain(row[3]) and plain(row[4]) == plain(row[5])
    assert row[6] == (bool(values) and len(set(map(str, values))) == 1)


def dense(spark):
    runs = "array<struct<channel_idx:int,runs:array<struct<start:int,length:int,value:float>>>>"
    rows = [
        (1, D0, 0, 3, [(0, [(0, 700, 1.0)]), (1, [(600, 200, NAN), (900, 540, 2.0)])]),
        (1, D0 + dt.timedelta(1), 0, 1, [(0, [(10, 1, 4.0)])]),
        (2, D0, 0, 0, []),
    ]
    days = spark.createDataFrame(rows, f"participant_id long, date date, original_time_offset int, zero_bits int, channels {runs}")
    windows = spark.createDataFrame([(1, D0, D0 + dt.timedelta(1)), (2, D0, D0 + dt.timedelta(1))], SAMPLE.rstrip(", "))
    return samples.with_placeholders(windows, days, [0, 1])


def sorts_and_groupings(df):
    plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return plan[1].count("Sort ["), plan[0].count("Aggregate(")


def test_dense_rows_are_gathered_as_they_come(spark):
    rows = dense(spark)
    before = sorts_and_groupings(rows)
    flat = samples.flatten_days(rows)
    split = evaluate.last_day_forecast(samples.split_days(rows, 1440, 1440))
    for out in (flat, split, post.mask_channels_with_empty_day(rows)):
        assert sorts_and_groupings(out) == before
    lists = {(r[0], r[3]): plain(r[4]) for r in flat.collect()}
    assert len(lists) == 4 and all(len(v) == 2880 for v in lists.values())
    assert lists[1, 0][:701] == [1.0] * 700 + [0.0] and lists[1, 0][1449:1452] == [0.0, 4.0, 0.0]
    assert lists[1, 1][599:601] == [0.0, "nan"] and lists[1, 1][1440:] == ["nan"] * 1440


def test_forecast_keeps_every_target_day(spark):
    out = evaluate.last_day_forecast(samples.split_days(dense(spark), 1440, 1440))
    assert out.columns == ["participant_id", "start_date", "end_date", "channel_idx", "forecast", "role_day", "target", "mask"]
    got = {(r.participant_id, r.channel_idx): (r.forecast[0], r.target[10]) for r in out.collect()}
    assert len(got) == 4 and got[1, 0] == (1.0, 4.0)


def test_stretches_without_any_channel(spark):
    masks = {0: [1] * 10 + [0] * 90, 1: [0] * 60 + [1] + [0] * 39, 2: [0] * 100}
    rows = [(1, D0, D0, 0, c, m) for c, m in masks.items()] + [(2, D0, D0, 0, 0, [0] * 100), (3, D0, D0, 0, 0, [1] * 100)]
    df = spark.createDataFrame(rows, SAMPLE + "day_index int, channel_idx int, mask array<tinyint>")
    out = sorted((r.participant_id, r.start_minute, r.end_minute) for r in post.all_channels_masked(df, 39).collect())
    assert out == [(1, 10, 60), (1, 61, 100), (2, 0, 100)]
    plan = df.select(F.lit(1)).limit(1) and post.all_channels_masked(df, 39)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(mask" not in plan


def test_one_file_per_participant(spark, tmp_path):
    rows = spark.range(400).select(
        F.when(F.col("id") % 8 != 0, F.col("id") % 8).alias("participant_id"), F.col("id").alias("record_id"), F.lit("healthkit").alias("modality")
    )
    files.write_raw(rows.repartition(16, "record_id"), str(tmp_path / "raw"))
    written = list((tmp_path / "raw" / "healthkit").rglob("*.parquet"))
    assert len(written) == 8
    assert spark.read.parquet(str(tmp_path / "raw" / "healthkit")).count() == 400


def test_a_large_participant_takes_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PARTICIPANT_ROWS", 50)
    rows = spark.range(400).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("participant_id"), "id")
    files.write_stats_per_participant(rows, str(tmp_path / "stats"))
    assert 2 <= len(list((tmp_path / "stats" / "user=1").rglob("*.parquet"))) <= 4
    assert files.read_stats_per_participant(spark, str(tmp_path / "stats")).count() == 400


def test_heart_rate_runs_of_all_samples(spark):
    from daygrid.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    got, alone = (sorted(map(tuple, QUERIES[q](spark, d).collect())) for q in ("m04_heart_rate_masked_runs", "m04b_heart_rate_masked_runs_alone"))
    assert got == alone and got


def test_minutes_are_listed_after_all_sums_and_joins(spark):
    from daygrid.operators import grid

    cuts = [(1, D0, 0, 30, 86400, 2.0), (1, D0, 1, 0, 60, 1.0), (1, D0, 1, 70, 100, 3.0), (1, D0, 1, 100, 125, 5.0), (1, D0, 1, 125, 250, 7.0), (2, D0, 0, 5, 6, 9.0)]
    segments = spark.createDataFrame(cuts, "participant_id long, date date, channel_idx int, sec int, sec_end int, v double")
    want = {}
    for p, day, c, a, b, v in cuts:
        for s in range(a, b):
            want.setdefault((p, day, c, s // 60), []).append(v)
    got = {tuple(r[:4]): (r.value, r.covered_seconds) for r in grid.minute_means(segments).collect()}
    assert got.keys() == want.keys()
    assert all(n == len(want[k]) and math.isclose(v, sum(want[k]) / n) for k, (v, n) in got.items())
    stretches = grid.minute_stretches(segments).collect()
    assert len(stretches) == 8 and sum(r.minutes for r in stretches) == len(want)


def test_minutes_cross_no_exchange(spark):
    from daygrid.operators import grid

    records = [(1, D0, 0, "healthkit", "t", 0, 7_200_000_000, 1.0, None), (2, D0, 1, "healthkit", "t", 0, 90_000_000, 4.0, None)]
    parts = spark.createDataFrame(
        records, "participant_id long, date date, channel_idx int, modality string, type string, start_us long, end_us long, value double, confidence double"
    )
    days = spark.createDataFrame([(1, D0), (None, D0)], "participant_id long, date date")
    minutes = grid.minute_values(parts, days)
    assert sorted((r.participant_id, r.minute) for r in minutes.collect()) == [(1, m) for m in range(120)]
    of_kind = grid.modality_grid(parts, "healthkit")
    assert of_kind.count() == 122
    for df in (minutes, of_kind):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("sequence(") < plan.index("Join") and "Aggregate" not in plan[: plan.index("sequence(")]


def test_sums_of_arrays_as_cell_by_cell(spark):
    from daygrid.catalog.registry import position_sums

    lists = [[0.0] * 4, [NAN] * 3, [None, None], [], None, [1.0, NAN, 2.5], [1.0, None], [3.0, 0.5, 0.5]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, x array<double>")
    x = F.col("x")
    cells = df.select("i", A.total(x).alias("plain"), position_sums(x).alias("p"))
    want = {r.i: plain([r.plain, r.p.total, r.p.weighted]) for r in cells.collect()}
    out = A.with_sums(df, ["i"], {"s": "x", "again": x})
    for r in out.collect():
        assert plain(list(r.s or [None] * 3)) == want[r.i] == plain(list(r.again or [None] * 3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :].split("\n")[1]
    assert "_varied_s" in below and ", x#" not in below


def test_arrays_of_one_value_are_told_without_hashing(spark):
    df = spark.createDataFrame([([1.0, 1.0],)], "x array<double>")
    assert "array_distinct" not in df.select(A.is_constant(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
