"""Rows that keep their runs: what is made of them is the same as of cells, and cells are not gathered."""

import datetime as dt
import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from daygrid.functions import arrays as A
from daygrid.operators import evaluate, export, samples
from daygrid.sources import files

NAN = float("nan")
D0 = dt.date(2024, 1, 1)
KEY = ["participant_id", "start_date", "channel_idx"]


def plain(x):
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else "nan" if isinstance(x, float) and math.isnan(x) else x


def rows_of(df, *columns):
    return sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    """Two windows of three days, one of them twice: NaN, NULL and zero values, days without runs, an absent day."""
    kind = "array<struct<channel_idx:int,runs:array<struct<start:int,length:int,value:float>>>>"
    rows = [
        (1, D0, 0, 1, [(0, [(0, 700, 1.0)]), (1, [(600, 200, NAN), (900, 540, 2.0)])]),
        (1, D0 + dt.timedelta(1), 0, 3, [(0, [(10, 1, 4.0), (11, 30, 0.0)]), (2, [(1439, 1, None)])]),
        (1, D0 + dt.timedelta(2), 0, 0, [(0, [(0, 1440, 3.5)]), (1, [(29, 2, 5.0)])]),
        (2, D0, 0, 7, []),
    ]
    days = spark.createDataFrame(rows, f"participant_id long, date date, original_time_offset int, zero_bits int, channels {kind}")
    windows = [(p, D0, D0 + dt.timedelta(2)) for p in (1, 2, 2)]
    return spark.createDataFrame(windows, "participant_id long, start_date date, end_date date"), days


def both(tables, order=("channel_idx", "day_index")):
    return [samples.with_placeholders(*tables, [0, 1, 2], order=order, runs=runs) for runs in (False, True)]


def gathers_cells(df):
    """Whether a list of cells is collected: rows are read from tables, so cells stand in the plan as what makes them."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "collect_list" in line and ("values" in line or "flatten" in line)]


@pytest.mark.parametrize("prepare", [lambda df: df, samples.zero_missing])
def test_flattened_days(tables, prepare):
    dense, runs = (samples.flatten_days(prepare(df)) for df in both(tables))
    want = rows_of(dense, *KEY, "values", "mask")
    assert len(want) == 6 and want == rows_of(runs, *KEY, "values", "mask")
    assert not gathers_cells(runs)


def test_segments(tables):
    dense, runs = (samples.segments(df) for df in both(tables, ("day_index", "channel_idx")))
    want = rows_of(dense, "participant_id", "segment", "values", "mask")
    assert len(want) == 2 * 144 and want == rows_of(runs, "participant_id", "segment", "values", "mask")
    assert dense.dtypes == runs.dtypes


@pytest.mark.parametrize("masked_as_nan", [False, True])
def test_series_records(tables, masked_as_nan):
    numbered = tables[0].distinct().withColumn("row_number", F.col("participant_id"))
    # A window that is there twice has twice the channels and is no whole record.
    made = [
        export.series_records(samples.flatten_days(df), numbered, masked_as_nan=masked_as_nan, features=3)
        for df in both((tables[0].distinct(), tables[1]))
    ]
    want, got = (rows_of(df, "item_id", "target", "feat_dynamic_real") for df in made)
    assert len(want) == 2 and want == got and made[0].dtypes == made[1].dtypes


def test_last_day_forecast(tables):
    columns = [*KEY, "role_day", "forecast", "target", "mask"]
    made = [samples.window_samples(*tables, [0, 1, 2], runs=runs) for runs in (False, True)]
    dense, runs = (evaluate.last_day_forecast(samples.split_days(df, 2 * 1440, 1440)) for df in made)
    want = rows_of(dense, *columns)
    assert len(want) == 9 and want == rows_of(runs, *columns)


def test_post_processors_get_no_runs(tables):
    assert "runs" in samples.window_samples(*tables, [0], runs=True).columns
    assert "runs" not in samples.window_samples(*tables, [0], runs=True, postprocessors=[samples.zero_missing]).columns


def test_cells_are_summed_row_by_row(spark):
    from daygrid.catalog.registry import position_sums

    lists = [[0.0] * 4, [NAN] * 3, [None, None], [], None, [1.0, NAN, 2.5], [1.0, None], [None, 0.0], [3.0, 0.5, 0.5], [0.0, 0.0, 7.0]]
    df = spark.createDataFrame([(1, v) for v in lists * 2], "i int, x array<double>").coalesce(1)
    out = A.with_cell_sums(df, ["i"], "x", "s")
    want = sorted(repr(plain([r.p.total, r.p.weighted])) for r in df.select(position_sums(F.col("x")).alias("p")).collect())
    assert out.columns == ["i", "s"]
    assert sorted(repr(plain(list(r.s or [None] * 2))) for r in out.collect()) == want
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_report_reads_cells_once(spark):
    cells = [
        ("a", 0, 1.0, 2.0, 1), ("a", 0, 2.0, 2.4, 1), ("a", 0, 4.0, 2.0, 1), ("b", 0, 1.0, None, 1), ("b", 1, 1.0, 1.0, 0),
        (None, 2, 3.0, 1.0, 1), (None, 2, 1.0, NAN, 1), ("c", 3, 1.0, 2.0, None), ("d", 4, None, 1.0, 1), ("a", None, 1.0, 3.0, 1),
    ]
    df = spark.createDataFrame(cells, "sample_id string, channel_idx int, y double, yhat double, mask int")
    names = spark.createDataFrame([(0, "zero"), (2, "two"), (4, "four")], "channel_idx int, channel string")
    out = evaluate.report(df, names)
    errors, r = evaluate.masked_errors(df).collect(), evaluate.mean_correlation(df).collect()
    text = lambda v: "NaN" if math.isnan(v) else f"{v:.4f}"
    named = {0: "zero", 2: "two", None: "Overall"}
    want = [(named[e.channel_idx], text(e.mae), text(e.mse), text(p.pearson)) for e in errors for p in r if e.channel_idx == p.channel_idx]
    assert len(want) == 6 and sorted(tuple(x) for x in out.collect()) == sorted(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [sample_id") == 1


def test_row_groups_of_series_are_bounded(spark, tmp_path):
    df = spark.range(300, numPartitions=1).select(F.array_repeat(F.lit(0.0), 5000).alias("target"))
    files.write_series(df, str(tmp_path / "series"))
    found = [pq.ParquetFile(p).metadata for p in (tmp_path / "series").glob("*.parquet")]
    sizes = [m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)]
    assert sum(sizes) == 300 and max(sizes) <= files.SERIES_IN_GROUP
