"""Days as runs: form, expansion, what is shuffled, and incremental builds from files."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from test_goldens import frame, record

from daygrid import constants as C
from daygrid.catalog import QUERIES
from daygrid.operators import days as D
from daygrid.operators import export, samples
from daygrid.plans import incremental
from daygrid.sources import files

SF = "/root/testdata/sf0.001"
STORED = f"participant_id long, date date, original_time_offset int, zero_bits int, channels {D.CHANNELS}"
NEW_YEAR = dt.date(2022, 1, 1)


def runs_of(spark, minutes):
    """Runs and dense rows of one day, given {channel: {minute: value}}."""
    rows = [(1, NEW_YEAR, c, m, v) for c, values in minutes.items() for m, v in values.items()]
    days = spark.createDataFrame([(1, NEW_YEAR, 60, 1, True)], "participant_id long, date date, original_time_offset int, channel_bits int, has_sleep boolean")
    schema = "participant_id long, date date, channel_idx int, minute int, value double"
    return D.compact(spark.createDataFrame(rows, schema).repartition(3), days)


def test_runs_of_stretches_as_of_minutes(spark):
    from daygrid.operators import grid

    rows = [(1, 0, 0, 60, 1.0), (1, 0, 60, 1, 1.0), (1, 0, 61, 30, 2.0), (1, 5, 10, 1, 0.5), (1, 5, 12, 2, 0.5), (None, 0, 3, 4, 1.0)]
    stretches = spark.createDataFrame(
        [(p, NEW_YEAR, *r) for p, *r in rows], "participant_id long, date date, channel_idx int, minute int, minutes int, value double"
    )
    schema = "participant_id long, date date, original_time_offset int, channel_bits int, has_sleep boolean"
    days = spark.createDataFrame([(1, NEW_YEAR, 60, 1, True), (None, NEW_YEAR, 60, 1, True)], schema)
    stored = D.compact(stretches, days)
    got = {r.participant_id: {c.channel_idx: [tuple(x) for x in c.runs] for c in r.channels} for r in stored.collect()}
    assert got == {1: {0: [(0, 61, 1.0), (61, 30, 2.0)], 5: [(10, 1, 0.5), (12, 2, 0.5)]}, None: {}}
    assert str(D.compact(grid.every_minute(stretches), days).orderBy("participant_id").collect()) == str(stored.orderBy("participant_id").collect())
    plan = stored._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[plan.rindex("RepartitionByExpression") :]


def test_runs_and_back(spark):
    minutes = {0: {0: 1.0, 1: 1.0, 2: 2.0, 9: 2.0, 1439: 5.0}, 5: {m: 0.5 for m in range(1440)}, 20: {7: 0.0}}
    stored = runs_of(spark, minutes)
    (row,) = stored.collect()
    assert row["zero_bits"] == 1 | 3 << 16 and row["original_time_offset"] == 60
    assert {c["channel_idx"]: [tuple(r) for r in c["runs"]] for c in row["channels"]} == {
        0: [(0, 2, 1.0), (2, 1, 2.0), (9, 1, 2.0), (1439, 1, 5.0)], 5: [(0, 1440, 0.5)], 20: [(7, 1, 0.0)],
    }
    assert stored.where(D.well_formed()).count() == 1
    dense = {r["channel_idx"]: r for r in D.expand(stored).collect()}
    assert set(dense) == set(range(24))
    for c, r in dense.items():
        fill = 0.0 if c in (0, 16, 17) else float("nan")
        want = [minutes.get(c, {}).get(m, fill) for m in range(1440)]
        assert str(r["values"]) == str(want) and r["mask"] == [int(v == v and v != 0) for v in want]
    assert [r["channel_idx"] for r in D.expand(stored, [5, 20]).collect()] == [5, 20]
    stats = {r["channel_idx"]: (r["n"], r["sum"], r["sum_of_squares"]) for r in D.statistics(stored).collect()}
    assert stats[0] == (5, 11, 35) and stats[5] == (1440, 720, 360) and stats[20] == stats[3] == (0, 0, 0)


@pytest.mark.parametrize(
    "channels",
    [
        [(24, [(0, 1, 1.0)])], [(3, [(0, 1, 1.0)]), (3, [(4, 1, 1.0)])], [(3, [(-1, 2, 1.0)])], [(3, [(0, 0, 1.0)])],
        [(3, [(1400, 41, 1.0)])], [(3, [(0, 5, 1.0), (4, 1, 2.0)])], [(5, []), (4, [])], [(3, [(0, 1, None)])], [(3, None)], None,
    ],
    ids=range(10),
)
def test_malformed_days_are_left_out(spark, channels):
    df = spark.createDataFrame([(1, NEW_YEAR, 0, 0, channels), (1, NEW_YEAR, 0, 0, [])], STORED)
    assert [r["channels"] for r in df.where(D.well_formed()).collect()] == [[]]


@pytest.mark.parametrize("name", ["i14_segments", "i15_flatten_days", "i17_window_samples", "i19_split_by_day", "x01_series_records", "m03_channels_with_empty_day"])
def test_no_exchange_below_arrays(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    exchanges = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: (.*)$", plan, re.M)
    assert exchanges and not [x for x in exchanges if re.search(r"\b(values|mask|_c|_d)#", x)]


def test_no_action_while_samples_are_planned(spark):
    tracker = spark.sparkContext.statusTracker()
    windows = spark.createDataFrame([(1, NEW_YEAR, NEW_YEAR + dt.timedelta(6))], "participant_id long, start_date date, end_date date")
    days = spark.createDataFrame([], STORED)
    spark.sparkContext.setJobGroup("planned", "")
    out = samples.with_placeholders(windows, days)
    assert not tracker.getJobIdsForGroup("planned")
    spark.sparkContext.setJobGroup("other", "")
    assert out.count() == 7 * 24 and out.where("is_placeholder").count() == 7 * 24


def test_uneven_samples_are_detected(spark):
    rows = [(p, NEW_YEAR, NEW_YEAR, c) for p, n in ((1, 24), (2, 24), (3, 23)) for c in range(n)]
    df = spark.createDataFrame(rows, "participant_id long, start_date date, end_date date, channel_idx int")
    assert {tuple(r) for r in export.feature_count(df).collect()} == {(24, 2), (23, 1)}


def steps(participant, day, hours, value=60.0, **more):
    row = list(record(C.QUANTITY, f"{day} {hours[0]}", f"{day} {hours[1]}", type=C.STEP_COUNT, value=value))
    row[0] = participant
    return tuple(row)


def asleep(participant, day):
    row = list(record(C.SLEEP, f"{day} 22:00", f"{day} 23:00", category=C.ASLEEP, value=3600.0))
    row[0] = participant
    return tuple(row)


class Folder:
    """A folder that files are added to, and what runs over it opened."""

    def __init__(self, spark, path):
        self.spark, self.source, self.opened = spark, str(path / "in"), []
        self.paths = [str(path / x) for x in ("days", "stats", "ledger")]

    def add(self, *rows):
        frame(self.spark, *rows).write.mode("append").parquet(self.source)

    def run(self, **more):
        def read(spark, paths):
            self.opened += paths
            return files.read_records(spark, paths)

        self.opened = []
        return incremental.build_days_from_files(self.spark, self.source, *self.paths, read=read, **more)

    def seconds(self):
        """Sum of steps of each day, from the days and from the statistics."""
        out = []
        for rows in (
            D.statistics(self.spark.read.parquet(self.paths[0])).where("channel_idx = 0"),
            self.spark.read.parquet(self.paths[1]).where("feature_index = 0"),
        ):
            out.append({(r["participant_id"], r["date"].day): round(r["sum"] * 60, 3) for r in rows.collect()})
        assert out[0] == out[1]
        return out[0]


def test_only_new_files_are_opened(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.add(steps(1, "2022-01-01", ("08:00", "09:00")), steps(2, "2022-01-01", ("08:00", "09:00")))
    assert f.run() and f.seconds() == {(1, 1): 60, (2, 1): 60}
    before = sorted(tmp_path.rglob("part-*.parquet"))
    assert f.run() == [] and f.opened == [] and sorted(tmp_path.rglob("part-*.parquet")) == before
    f.add(steps(1, "2022-01-02", ("08:00", "09:00"), 120.0))
    taken = f.run()
    assert taken and f.seconds() == {(1, 1): 60, (2, 1): 60, (1, 2): 120}
    assert f.run() == [] and f.opened == []


def test_late_files(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.add(steps(1, "2022-01-01", ("08:00", "09:00")), steps(3, "2022-01-01", ("08:00", "09:00")))
    f.run()
    f.add(steps(1, "2022-01-01", ("10:00", "11:00"), 30.0))
    f.run()
    assert f.seconds() == {(1, 1): 60, (3, 1): 60}
    f.add(steps(1, "2022-01-01", ("12:00", "13:00"), 9.0), steps(2, "2022-01-05", ("08:00", "09:00")))
    f.run(late="rebuild")
    assert f.seconds() == {(1, 1): 99, (3, 1): 60, (2, 5): 60}
    with pytest.raises(ValueError):
        f.run(late="sometimes")


def test_older_files_add_to_new_days(spark, tmp_path):
    f = Folder(spark, tmp_path)
    f.add(asleep(1, "2022-01-01"), steps(2, "2022-01-01", ("08:00", "09:00")))
    f.run()
    assert f.seconds() == {(2, 1): 60}
    f.add(steps(1, "2022-01-01", ("08:00", "09:00")))
    f.run(skip=[7])
    assert f.seconds() == {(2, 1): 60, (1, 1): 60}
    slept = spark.read.parquet(f.paths[1]).where("participant_id = 1 AND n > 0").select("feature_index").collect()
    assert {r[0] for r in slept} == {0, C.CHANNEL_INDEX[C.ASLEEP]}


def test_a_run_that_dies_is_repeated(spark, tmp_path, monkeypatch):
    f = Folder(spark, tmp_path)
    f.add(steps(1, "2022-01-01", ("08:00", "09:00")))

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(incremental, "add_statistics", dies)
        f.run()
    assert f.run() and f.seconds() == {(1, 1): 60}
