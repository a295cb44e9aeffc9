"""Row-local normalisation, the order of the mask rules, and the baseline forecast."""

import datetime as dt
import math

import pytest

from daygrid.operators import evaluate, post

DAY = dt.date(2022, 1, 1)
SAMPLE = "participant_id long, start_date date, end_date date, day_index int, channel_idx int"


@pytest.mark.parametrize("options", [{}, {"subtract_last": True}, {"affine": (2.0, 0.5)}, {"skip_flat": True}])
def test_normal_form_and_back(spark, options):
    rows = [(1, [math.sin(i) * 50 + i for i in range(1440)]), (2, [3.0] * 1440), (3, [5.0])]
    df = spark.createDataFrame(rows, "id long, values array<double>")
    out = post.instance_denormalise(post.instance_normalise(df, **options), into="restored")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert r["restored"] == pytest.approx(rows[r["id"] - 1][1], abs=1e-6 if "affine" in options else 1e-9)
        x = r["values"]
        if r["id"] == 1 and not options:
            assert sum(x) / 1440 == pytest.approx(0, abs=1e-9) and sum(v * v for v in x) / 1440 == pytest.approx(1, rel=1e-6)
        if r["id"] == 2 and "skip_flat" in options:
            assert x == [3.0] * 1440


def test_blanked_heart_rate_channels_list_no_runs(spark):
    end = DAY + dt.timedelta(1)
    gap = [1] * 10 + [0] * 30 + [1] * 10
    rows = [
        (1, DAY, end, 0, post.HEART_RATE_CHANNEL, gap), (1, DAY, end, 1, post.HEART_RATE_CHANNEL, [1] * 50),
        (2, DAY, end, 0, post.HEART_RATE_CHANNEL, gap), (2, DAY, end, 1, post.HEART_RATE_CHANNEL, [0] * 50),
        (1, DAY, end, 0, 0, [0] * 50),
    ]
    df = spark.createDataFrame(rows, f"{SAMPLE}, mask array<tinyint>")
    found = lambda **k: sorted((r["participant_id"], r["day_index"], r["start_minute"], r["end_minute"]) for r in post.heart_rate_masked_runs(df, 20, **k).collect())
    assert found() == [(1, 0, 10, 40)]
    assert found(after_blanking=False) == [(1, 0, 10, 40), (2, 0, 10, 40), (2, 1, 0, 50)]
    assert found(indices=[0]) == []


def test_the_last_input_day_is_the_forecast(spark):
    rows = [(1, DAY, DAY, role, n, 3, [float(10 * n + i + (role == "y")) for i in range(4)], [1, 0, 1, 1]) for role, n in (("x", 0), ("x", 1), ("y", 0), ("y", 1))]
    df = spark.createDataFrame(rows, "participant_id long, start_date date, end_date date, role string, role_day int, channel_idx int, values array<double>, mask array<tinyint>")
    out = {r["role_day"]: r for r in evaluate.last_day_forecast(df.repartition(3)).collect()}
    assert {k: r["forecast"] for k, r in out.items()} == {k: [10.0, 11.0, 12.0, 13.0] for k in (0, 1)}
    cells = evaluate.forecast_cells(evaluate.last_day_forecast(df)).where("mask = 1")
    assert {tuple(r) for r in cells.where("role_day = 0").select("minute", "y", "yhat").collect()} == {(0, 1.0, 10.0), (2, 3.0, 12.0), (3, 4.0, 13.0)}


def test_non_finite_errors(spark):
    rows = [(1, 0, 1.0, 2.0, 1), (1, 0, 1.0, math.nan, 1), (1, 1, 1.0, math.inf, 1), (1, 1, 1.0, 3.0, 1), (1, 2, 1.0, 9.0, 0)]
    df = spark.createDataFrame(rows, "sample_id long, channel_idx int, y double, yhat double, mask int")
    guarded = {r["channel_idx"]: r["mae"] for r in evaluate.masked_errors(df).collect()}
    plain = {r["channel_idx"]: r["mae"] for r in evaluate.masked_errors(df, finite_guard=False).collect()}
    assert (guarded[0], guarded[1], guarded[None]) == (0.5, 1.0, 0.75) and math.isnan(guarded[2])
    assert math.isnan(plain[0]) and plain[1] == math.inf and math.isnan(plain[None])
