"""Small worked examples of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import arrays as A
from daygrid.functions.quantiles import exact_quantiles
from daygrid.operators import clean, grid, intervals, labels, post, samples, windows
from daygrid.plans.grid import day_grid
from daygrid.sources.files import RECORD_SCHEMA

EPOCH = dt.datetime(1970, 1, 1)


def us(text):
    return int((dt.datetime.fromisoformat(text) - EPOCH) / dt.timedelta(microseconds=1))


def record(modality, start, end, **extra):
    row = dict.fromkeys(RECORD_SCHEMA.names)
    row.update(
        participant_id=1, record_id=1, modality=modality, start_us=us(start), end_us=us(end),
        start_offset=0, end_offset=0, **extra,
    )
    return tuple(row[c] for c in RECORD_SCHEMA.names)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD_SCHEMA)


def parts(df):
    return intervals.with_channel(intervals.with_local_date(df))


def test_one_record_per_modality(spark):
    df = frame(
        spark,
        record(C.QUANTITY, "2022-01-01 00:00", "2022-01-01 01:00", type=C.STEP_COUNT, value=3600.0),
        record(C.WORKOUT, "2022-01-01 03:00", "2022-01-01 03:30", workout_type=C.WORKOUT_TYPES[2]),
        record(C.SLEEP, "2022-01-01 22:00", "2022-01-01 23:00", category=C.ASLEEP, value=3600.0),
        record(C.MOTION, "2022-01-01 00:10", "2022-01-01 00:20", activity="stationary", confidence=5.0),
    )
    rows = {r.channel_idx: r for r in day_grid(df).collect()}
    assert len(rows) == 24
    nan = float("nan")
    expected = {
        0: [1.0] * 60 + [0.0] * 1380,
        8: [0.0] * 180 + [1.0] * 30 + [0.0] * 1230,
        16: [0.0] * 1320 + [1.0] * 60 + [0.0] * 60,
        17: [0.0] * 1440,
        18: [nan] * 10 + [5.0] * 10 + [nan] * 1420,
    }
    for i, row in rows.items():
        want = expected.get(i, [nan] * 1440)
        assert str(row["values"]) == str(want), i
        assert row["mask"] == [int(v == v and v != 0) for v in want], i


def test_units(spark):
    df = spark.createDataFrame(
        [(10.0, "ft"), (150.0, "lb"), (60.0, "mph"), (1.0, "count/s"), (5000.0, "cal")], "value double, unit string"
    )
    got = clean.normalise_units(df).collect()
    assert [r.unit for r in got] == ["m", "kg", "m/s", "count/s", "cal"]
    assert [r.value for r in got] == pytest.approx([3.048, 150 * 0.45359237, 26.8224, 1.0, 5000.0])


def test_midnight_split(spark):
    df = frame(spark, record(C.QUANTITY, "2022-01-01 23:30", "2022-01-02 00:30", type=C.STEP_COUNT, value=3600.0))
    got = sorted((r.start_us, r.end_us, r.value) for r in intervals.split_at_midnight(df).collect())
    assert got == [
        (us("2022-01-01 23:30"), us("2022-01-01 23:59:58"), pytest.approx(1798.0)),
        (us("2022-01-02 00:00"), us("2022-01-02 00:30"), pytest.approx(1800.0)),
    ]


def test_sleep_split(spark):
    df = frame(spark, record(C.SLEEP, "2022-01-01 22:45", "2022-01-01 22:45", category=C.ASLEEP, value=5400.0))
    assert sorted(r.value for r in intervals.split_sleep_at_midnight(df).collect()) == [900.0, 4498.0]


def test_point_reading_covers_one_second(spark):
    df = parts(frame(spark, record(C.QUANTITY, "2022-01-01 08:30:15", "2022-01-01 08:30:15", type=C.HEART_RATE, value=1.5)))
    got = [(r.sec, r.sec_end, r.v) for r in grid.mean_segments(grid.second_intervals(df)).collect()]
    assert got == [(30615, 30616, 1.5)]


def test_overlapping_motion_is_averaged(spark):
    df = parts(frame(
        spark,
        record(C.MOTION, "2022-01-01 00:00", "2022-01-01 00:02", activity="walking", confidence=20.0),
        record(C.MOTION, "2022-01-01 00:01", "2022-01-01 00:02", activity="walking", confidence=30.0),
    ))
    assert sorted((r.minute, r.value) for r in grid.minute_values(df).collect()) == [(0, 20.0), (1, 25.0)]


def test_runs(spark):
    flags = [True, True, False, True, False, True, True, True]
    row = spark.range(1).select(A.runs(F.array(*[F.lit(f) for f in flags]), 2).alias("r")).first()
    assert [(r.start, r.end) for r in row.r] == [(0, 2), (5, 8)]


def test_gap_is_interpolated(spark):
    values, mask = [60.0] + [0.0] * 5 + [70.0], [1] * 7
    df = spark.createDataFrame([(values, mask)], "`values` array<double>, mask array<int>")
    got = post.fill_heart_rate(df).first()
    assert got["values"] == pytest.approx([60, 61.666667, 63.333333, 65, 66.666667, 68.333333, 70], abs=1e-5)


@pytest.mark.parametrize(
    "days, starts",
    [
        ([1, 2, 3, 5, 7, 9, 10, 11, 12, 15], [1, 9]),
        # The second window starts on day 18, the first candidate that reaches five days.
        ([1, 2, 3, 4, 5, 20, 21, 22, 23, 24, 26], [1, 18]),
        ([1, 2, 3], []),
        ([], []),
    ],
)
def test_greedy_windows(spark, days, starts):
    df = spark.createDataFrame([(days,)], "d array<int>")
    assert df.select(windows.greedy_windows(F.col("d")).alias("w")).first().w == starts


@pytest.mark.parametrize(
    ("days", "starts"),
    [
        (range(7), [0]),
        (range(14), [0, 7]),
        (range(6), []),
        ([0, 1, 2, 3, 6], [0]),
        ([0, 1, 2, 3, 7, 8, 9, 10, 11, 12], [5]),
        ([0, 1, 9, 10, 11, 12, 13, 14, 15], [7]),
        ([0, 10, 20, 30], []),
        ([*range(5), *range(30, 37)], [0, 28]),
    ],
)
def test_greedy_windows_with_gaps(spark, days, starts):
    df = spark.createDataFrame([(list(days),)], "d array<int>")
    assert df.select(windows.greedy_windows(F.col("d"))).first()[0] == starts


def test_exact_quantiles_match_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1009 / 7).alias("x"))
    got = exact_quantiles(df, ["g"], "x", [0.25, 0.5]).collect()
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("x", [0.25, 0.5]).alias("p")).collect()}
    for r in got:
        assert r["quantile"] == pytest.approx(want[r.g][0 if r.probability == 0.25 else 1])


def test_forecast_split_text():
    assert [samples.forecast_minutes(s) for s in C.COMMON_SPLITS] == [(7200, 2880), (10080, 4320), (14400, 7200)]
    assert samples.forecast_minutes(" 5-2d ") == samples.forecast_minutes("5-2d")
    with pytest.raises(ValueError):
        samples.forecast_minutes("5-2")


def test_parse_list(spark):
    texts = ["[1, 2]", "[1. 10.]", "[]", "x", "[1, 2 3]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(labels.parse_list(F.col("t")).alias("v")).collect()]
    assert got == [[1.0, 2.0], [1.0, 10.0], [], None, None]


def minute_means_of(spark, *rows):
    df = frame(spark, *rows)
    return {r.minute: r.value for r in grid.minute_values(parts(df)).collect()}


def test_zero_valued_overlaps_stay_zero(spark):
    steps = [("00:00", "00:10", 60.0), ("00:02", "00:12", 120.0), ("00:00", "00:30", 0.0)]
    df = frame(
        spark,
        *[record(C.QUANTITY, f"2022-01-01 {a}", f"2022-01-01 {b}", type=C.STEP_COUNT, value=v) for a, b, v in steps],
    )
    row = next(r for r in day_grid(df).collect() if r.channel_idx == 0)
    assert row["values"][12:30] == [0.0] * 18 and sum(row["mask"]) == 12
    motion = [("00:00", "00:10", 0.1), ("00:03", "00:12", 0.2), ("00:01", "00:30", 0.0)]
    got = minute_means_of(
        spark, *[record(C.MOTION, f"2022-01-01 {a}", f"2022-01-01 {b}", activity="stationary", confidence=v) for a, b, v in motion]
    )
    assert all(got[m] == 0.0 for m in range(12, 30)) and got[5] == pytest.approx(0.1)
    far = [("00:00", "00:10", 1e9), ("00:00", "00:20", 1e-12)]
    got = minute_means_of(
        spark, *[record(C.MOTION, f"2022-01-01 {a}", f"2022-01-01 {b}", activity="stationary", confidence=v) for a, b, v in far]
    )
    assert got[15] == pytest.approx(1e-12, rel=1e-5)


def test_stage_follows_its_source(spark, tmp_path):
    from daygrid.sources.session import stored_stage

    source = str(tmp_path / "in")
    spark.range(3).write.parquet(f"{source}/a")
    read = lambda: stored_stage(spark, source, "rows", lambda: spark.read.parquet(f"{source}/a")).count()
    assert read() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{source}/a")
    assert read() == 5


def test_materialised_tables_survive_half_written_folders(spark, tmp_path):
    from daygrid.sources import files

    folder, calls = str(tmp_path), []

    def build():
        calls.append(1)
        return spark.range(4)

    def dies():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        files.materialised(spark, folder, "k", dies)
    spark.range(2).write.parquet(f"{folder}/k-half")
    assert files.materialised(spark, folder, "k", build).count() == 4
    assert files.materialised(spark, folder, "k", build).count() == 4 and len(calls) == 1
    files.materialised(spark, folder, "k", build, force=True)
    assert len(calls) == 2
    assert files.sample_key("a", [], None, None, "x") != files.sample_key("a", [], None, None, "y")


def test_unreadable_files_fail_unless_asked(spark, tmp_path):
    from daygrid.sources import files

    path = str(tmp_path / "r")
    spark.createDataFrame([(1,)], "participant_id long").write.parquet(path)
    (tmp_path / "r" / "part-x.parquet").write_bytes(b"no parquet at all")
    schema = spark.createDataFrame([], "participant_id long").schema
    with pytest.raises(Exception, match="(?s)."):
        files.read_modality(spark, path, schema).count()
    assert files.read_modality(spark, path, schema, lenient=True).count() == 1
    assert [f.rsplit("/", 1)[-1] for f in files.skipped_files(spark, path, schema)] == ["part-x.parquet"]
    with pytest.raises(Exception, match="(?s)."):
        files.read_modality(spark, path + "-absent", schema)


def test_standardization_given_twice_is_an_error(spark):
    from daygrid.sources import files

    rows = [(i, float(i), 1.0) for i in range(24)]
    params = spark.createDataFrame(rows, "feature_index int, mean double, std_dev double")
    assert len(files.standardization_dict(params)) == 24
    with pytest.raises(ValueError, match="more than once"):
        files.standardization_dict(params.unionByName(params.limit(1)))


def test_rare_strata_raise_with_ten_examples(spark):
    from daygrid.operators import splits

    members = spark.createDataFrame([(i, f"s{i}") for i in range(30)], "participant_id long, s string")
    with pytest.raises(ValueError) as error:
        splits.require_no_rare_strata(members, ["s"])
    assert str(error.value).count("'n': 1") == 10


def test_records_are_pruned_and_filtered_at_the_scan(spark):
    from daygrid.sources import adapter

    records = adapter.records(spark, "/root/testdata/sf0.001")
    plan = records.where("participant_id = 7").select("participant_id").distinct()._jdf.queryExecution().toString()
    assert "ReadSchema: struct<participant_id:bigint>" in plan
    assert "EqualTo(participant_id,7)" in plan


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 999, 1000, 1001])
def test_quantiles_at_the_sketch_size(spark, rows):
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    df = spark.range(rows).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 10007 / 3).alias("x"))
    got = {r.probability: r["quantile"] for r in exact_quantiles(df, ["g"], "x", probabilities).collect()}
    want = df.agg(F.percentile("x", probabilities)).first()[0]
    assert [got[p] for p in probabilities] == pytest.approx(want)


def test_quantile_of_many_equal_rows(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), F.when(F.col("id") < 10, F.col("id")).otherwise(50).alias("x"))
    assert [r["quantile"] for r in exact_quantiles(df, ["g"], "x", [0.5]).collect()] == [50.0]


def test_incremental_runs(spark, tmp_path):
    from daygrid.plans.incremental import build_days

    days, statistics = str(tmp_path / "d"), str(tmp_path / "s")

    def steps(participant, day):
        row = list(record(C.QUANTITY, f"{day} 08:00", f"{day} 09:00", type=C.STEP_COUNT, value=60.0))
        row[0] = participant
        return tuple(row)

    def stored(path):
        return {(r[0], str(r[1])) for r in spark.read.parquet(path).select("participant_id", "date").distinct().collect()}

    first = frame(spark, steps(1, "2022-01-01"), steps(2, "2022-01-01"))
    build_days(spark, first, days, statistics, skip=[2])
    assert stored(days) == stored(statistics) == {(1, "2022-01-01")}
    more = first.unionByName(frame(spark, steps(1, "2022-01-02")))
    build_days(spark, more, days, statistics)
    want = {(1, "2022-01-01"), (1, "2022-01-02"), (2, "2022-01-01")}
    assert stored(days) == stored(statistics) == want
    n = len(list(tmp_path.rglob("part-*.parquet")))
    build_days(spark, more, days, statistics)
    assert len(list(tmp_path.rglob("part-*.parquet"))) == n
    build_days(spark, more, days, statistics, force_recompute=True)
    assert stored(days) == stored(statistics) == want
    from daygrid.operators.days import expand

    assert spark.read.parquet(days).count() == 3 and expand(spark.read.parquet(days)).count() == 24 * 3
