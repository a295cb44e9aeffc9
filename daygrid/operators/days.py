"""Days as runs: the stored form of the per-minute grid, and its expansion inside the reader.

A stored row is one participant's day: which channels are zero where nothing is recorded (``zero_bits``), and for each
channel that has data its runs (start, length, value). A channel without data takes no space, and a value that lasts an
hour takes one run, so a row is some hundred bytes where the dense form has 24 x 1440 values and masks. Runs are what is
shuffled, joined and stored; dense arrays appear in the task that uses them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid import constants as C
from daygrid.functions import arrays as A

DAY = ["participant_id", "date"]
KEY = [*DAY, "channel_idx"]
RUN = "struct<start:int,length:int,value:float>"
CHANNELS = f"array<struct<channel_idx:int,runs:array<{RUN}>>>"
#: Columns of channel rows that hold their cells as runs.
RUN_FORM = ["zero_fill", "runs"]
#: Cells that a task makes of runs in one go.
CELLS_AT_ONCE = 1 << 21


def tasks_of(df: DataFrame) -> int:
    """Tasks for rows that are expanded next: as the session says. Merged by their size as runs they would be too few."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def value_runs(stretches: Column) -> Column:
    """Sorted stretches (minute, minutes, value) of one day and channel as runs of adjacent minutes with one value."""

    def build(stretches):
        n = F.size(stretches)

        def end(i):
            return F.get(stretches, i)["minute"] + F.get(stretches, i)["minutes"]

        def begins(i):
            last, this = F.get(stretches, i - 1), F.get(stretches, i)
            return (i == 0) | (end(i - 1) != this["minute"]) | ~last["value"].eqNullSafe(this["value"])

        def cut(starts):
            ends = F.concat(F.slice(starts, 2, n), F.array(n))
            return F.zip_with(
                starts,
                ends,
                lambda a, b: F.struct(
                    F.get(stretches, a)["minute"].cast("int").alias("start"),
                    (end(b - 1) - F.get(stretches, a)["minute"]).cast("int").alias("length"),
                    F.get(stretches, a)["value"].alias("value"),
                ),
            )

        return A.let(F.filter(A.positions(n), begins), cut)

    return A.let(stretches, build)


def zero_bits(channel_bits: Column, has_sleep: Column) -> Column:
    """Channels whose uncovered minutes are zero; see ``intervals.fill_is_zero``."""
    from daygrid.operators.intervals import fill_is_zero

    bits = F.lit(0)
    for c in range(C.N_CHANNELS):
        bits = bits + F.when(fill_is_zero(F.lit(c), channel_bits, has_sleep), F.lit(1 << c)).otherwise(F.lit(0))
    return bits.cast("int")


def compact(minutes: DataFrame, days: DataFrame) -> DataFrame:
    """One row per output day: participant_id, date, original offset, zero_bits, channels (those with data, in order).

    ``minutes`` has a row per minute or, with a column of that name, per stretch of ``minutes`` from ``minute``. The rows of
    a day meet first, in as many tasks as the session says, each row once. Lists are made only there: those of one channel,
    at most 1440, then the runs of a day's channels, at most 24. Lists begun before the exchange would sort all rows of
    a file split, and send them as lists.
    """
    tasks = tasks_of(days)
    length = F.col("minutes") if "minutes" in minutes.columns else F.lit(1)
    stretch = F.struct("minute", length.alias("minutes"), F.col("value").cast("float").alias("value"))
    met = minutes.select(*KEY, stretch.alias("stretch")).repartition(tasks, *DAY)
    per_channel = met.groupBy(*KEY).agg(F.sort_array(F.collect_list("stretch")).alias("stretches"))
    runs = per_channel.select(*DAY, F.struct(F.col("channel_idx").cast("int").alias("channel_idx"), value_runs(F.col("stretches")).alias("runs")).alias("c"))
    per_day = runs.groupBy(*DAY).agg(F.sort_array(F.collect_list("c")).alias("channels"))
    bits = zero_bits(F.col("channel_bits"), F.col("has_sleep"))
    return days.select(*DAY, "original_time_offset", bits.alias("zero_bits")).repartition(tasks, *DAY).join(per_day, DAY, "left").select(
        *DAY, "original_time_offset", "zero_bits", F.coalesce("channels", F.array().cast(CHANNELS)).cast(CHANNELS).alias("channels")
    )


def well_formed() -> Column:
    """Whether a stored day can be expanded: known channels in order, runs in order, inside the day and not overlapping."""
    channels, n = F.col("channels"), C.MINUTES_PER_DAY

    def ordered(items, first, after):
        """Each item begins at or after the end of the one before it."""
        return F.forall(
            A.positions(F.size(items)),
            lambda i: (i == 0) | (first(F.get(items, i)) >= after(F.get(items, i - 1))),
        )

    def good(c):
        runs = c["runs"]
        inside = F.forall(runs, lambda r: (r["start"] >= 0) & (r["length"] > 0) & (r["start"] + r["length"] <= n) & r["value"].isNotNull())
        known = (c["channel_idx"] >= 0) & (c["channel_idx"] < C.N_CHANNELS)
        return known & inside & ordered(runs, lambda r: r["start"], lambda r: r["start"] + r["length"])

    in_order = ordered(channels, lambda c: c["channel_idx"], lambda c: c["channel_idx"] + 1)
    return F.coalesce(F.col("zero_bits").isNotNull() & F.forall(channels, good) & in_order, F.lit(False))


def dense(runs: Column, fill: Column, value=lambda r: r["value"], told: bool = True) -> Column:
    """1440 cells: ``value`` of a run in its minutes, ``fill`` elsewhere. Linear in the cells; generated code without runs.

    Not ``told`` apart, days without runs go the same way as others: inside a lambda, where code is not generated anyway and
    the folded array of a fixed ``fill`` would stand in the plan once more.
    """

    def build(runs):
        def end(i):
            return F.when(i > 0, F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"]).otherwise(F.lit(0))

        pieces = F.transform(
            runs,
            lambda r, i: F.concat(F.array_repeat(fill, r["start"] - end(i)), F.array_repeat(value(r), r["length"])),
        )
        return F.concat(F.flatten(pieces), F.array_repeat(fill, F.lit(C.MINUTES_PER_DAY) - end(F.size(runs))))

    if not told:
        return A.let(runs, build)
    empty = F.array_repeat(fill, F.lit(C.MINUTES_PER_DAY))
    return F.when(F.size(runs) == 0, empty).otherwise(A.let(runs, build))


def channel_rows(days: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """The wanted channels of each day, also those without data: other columns, channel_idx, zero_fill, runs. Row-local.

    A day that is missing (NULL ``zero_bits``) has no runs and missing values.
    """
    wanted = F.array(*[F.lit(c) for c in (range(C.N_CHANNELS) if channels is None else channels)])
    others = [c for c in days.columns if c not in ("zero_bits", "channels")]
    none = F.array().cast(f"array<{RUN}>")

    def row(c):
        own = F.get(F.filter("channels", lambda x: x["channel_idx"] == c), F.lit(0))
        zero = F.coalesce(F.getbit("zero_bits", c) == 1, F.lit(False))
        return F.struct(c.alias("channel_idx"), zero.alias("zero_fill"), F.coalesce(own["runs"], none).alias("runs"))

    return days.select(*others, F.inline(F.transform(wanted, row)))


def expand(days: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """Dense rows: other columns, channel_idx, values, mask (1 where a value is neither zero nor missing). Row-local."""
    return densify(channel_rows(days, channels))


def densify(rows: DataFrame, keep: bool = False) -> DataFrame:
    """Dense form of channel rows. Row-local: the order of the rows stays.

    With ``keep`` the runs stay beside the cells, for operators that pick or gather rows first and make cells of what is
    left. Cells that no reader asks for are not made. Who changes cells has to change the runs alike or drop them.
    """
    others = [c for c in rows.columns if c not in RUN_FORM]
    return rows.select(*others, *cells("zero_fill", "runs"), *(RUN_FORM if keep else []))


def cells(zero_fill: Column | str, runs: Column | str) -> list[Column]:
    """Columns ``values`` and ``mask`` (1 where a value is neither zero nor missing) of runs."""
    zero_fill, runs = (F.col(c) if isinstance(c, str) else c for c in (zero_fill, runs))
    fill = F.when(zero_fill, F.lit(0.0)).otherwise(F.lit(float("nan"))).cast("float")
    flag = lambda r: A.observed(r["value"]).cast("tinyint")
    return [dense(runs, fill).alias("values"), dense(runs, F.lit(0).cast("tinyint"), flag).alias("mask")]


def with_run_values(df: DataFrame, f) -> dict[str, Column]:
    """Run form of rows whose missing cells become zero and whose values go through ``f``; nothing where runs are not kept."""
    if "runs" not in df.columns:
        return {}
    run = lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), f(r["value"]).cast("float").alias("value"))
    return {"zero_fill": F.lit(True), "runs": F.transform("runs", run)}


def joined_cells(entries: Column, masked_as_nan: bool = False, flag_type: str = "tinyint") -> tuple[Column, Column]:
    """``values`` and ``mask`` of a list of days (zero_fill, runs), one after the other; ``masked_as_nan``: NaN where the mask is 0.

    Lists without any run, as channels without data have, are one repeated value, which runs as generated code.
    """
    n, first, nan = F.size(entries) * C.MINUTES_PER_DAY, F.get(entries, F.lit(0)), F.lit(float("nan")).cast("float")
    plain = ~F.exists(entries, lambda d: (F.size(d["runs"]) > 0) | (d["zero_fill"] != first["zero_fill"]))
    zero, flag = F.lit(0).cast(flag_type), lambda r: A.observed(r["value"]).cast(flag_type)

    def fill(d):
        return nan if masked_as_nan else F.when(d["zero_fill"], F.lit(0.0).cast("float")).otherwise(nan)

    def value(r):
        return F.when(A.observed(r["value"]), r["value"]).otherwise(nan) if masked_as_nan else r["value"]

    def joined(once, one_day):
        return F.when(plain, F.array_repeat(once, n)).otherwise(F.flatten(F.transform(entries, one_day)))

    return joined(fill(first), lambda d: dense(d["runs"], fill(d), value, False)), joined(zero, lambda d: dense(d["runs"], zero, flag, False))


def cell_pieces(minutes: int, day: int = C.MINUTES_PER_DAY, at_once: int = CELLS_AT_ONCE):
    """A function of lists in tasks, for ``cut_cells``; it needs nothing of this package where it runs."""
    per_day = day // minutes

    def offsets(sizes: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())

    def sizes_of(lists: pa.Array) -> np.ndarray:
        return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def cells_of(entries: pa.StructArray) -> list[np.ndarray]:
        """Cells of all entries, one after the other: values, mask, whether NULL, whether zero without a run."""
        n, runs = len(entries), entries.field("runs")
        zero, flat = np.asarray(entries.field("zero_fill"), dtype=bool), runs.flatten()
        first, lengths = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "length"))
        value = flat.field("value")
        missing = np.asarray(value.is_null(), dtype=bool)
        value = value.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        first = first + np.repeat(np.arange(n, dtype=np.int64) * day, sizes_of(runs))
        place = np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
        values, mask, absent, blank = (np.zeros(n * day, kind) for kind in (np.float32, np.int8, bool, bool))
        blank.reshape(n, day)[zero] = True
        values.reshape(n, day)[~zero] = np.nan
        blank[place] = False
        values[place] = np.repeat(value, lengths)
        mask[place] = np.repeat((value != 0) & ~np.isnan(value), lengths)
        absent[place] = np.repeat(missing, lengths)
        return [values, mask, absent, blank]

    def pieces(lists: pa.ListArray) -> pa.ListArray:
        sizes = sizes_of(lists)
        ends = np.concatenate([[0], np.cumsum(sizes)]) * day
        made, kept, full = cells_of(lists.flatten()), [[], [], []], []
        for a, b in zip(ends[:-1], ends[1:]):
            values, mask, absent, blank = (x[a:b].reshape(-1, per_day, minutes).swapaxes(0, 1).reshape(per_day, -1) for x in made)
            full.append(~blank.all(1))
            for out, x in zip(kept, (values, mask, absent)):
                out.append(x[full[-1]].ravel())
        lengths = np.repeat(sizes * minutes, per_day) * np.concatenate(full)
        values, mask, absent = (np.concatenate(x) for x in kept)
        columns = [pa.array(values, mask=absent if absent.any() else None), pa.array(mask)]
        lists_of = [pa.ListArray.from_arrays(offsets(lengths), c, mask=pa.array(~np.concatenate(full))) for c in columns]
        return pa.ListArray.from_arrays(offsets(np.full(len(sizes), per_day)), pa.StructArray.from_arrays(lists_of, ["values", "mask"]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            reach, at = np.cumsum(sizes_of(lists)) * day, 0
            while at < len(lists):
                end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + at_once, "right")))
                yield pieces(lists.slice(at, end - at))
                at = end

    return run


def cut_cells(entries: Column, minutes: int) -> Column:
    """Array of structs of ``values`` and ``mask``, one for each ``minutes`` of the day: the cells of all channels of a list of
    (zero_fill, runs) in these minutes, side by side; NULL where no run reaches into them and all channels are zero.

    Made in slices of about ``CELLS_AT_ONCE`` cells, so that neither a task nor its answers hold those of a whole batch.
    """
    # Not called deterministic, as a predicate inferred from the list it returns would call it again.
    cut = F.arrow_udf(cell_pieces(minutes), "array<struct<values:array<float>,mask:array<tinyint>>>").asNondeterministic()
    return cut(entries)


def statistics(days: DataFrame) -> DataFrame:
    """Observed minutes, sum and sum of squares of all 24 channels of each stored day, from its runs. Row-local."""
    rows = channel_rows(days)
    seen = F.filter("runs", lambda r: A.observed(r["value"]))

    def total(of):
        return F.aggregate(seen, F.lit(0.0), lambda a, r: a + of(r["value"].cast("double")) * r["length"])

    others = [c for c in rows.columns if c not in ("zero_fill", "runs")]
    n = total(lambda v: F.lit(1.0))
    return rows.select(
        *others,
        (n * 100 / C.MINUTES_PER_DAY).alias("data_coverage"),
        n.alias("n"),
        total(lambda v: v).alias("sum"),
        total(lambda v: v * v).alias("sum_of_squares"),
    )
