"""Row-local operations on per-day arrays. None of them explodes or shuffles.

A day of one channel is an array of 1440 values, so every list built here is bounded by the day length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = "struct<plain:double,total:double,weighted:double>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside a lambda is substituted by its defining expression and would be recomputed for
    every element; bound as the lambda's own variable it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_constant(values: Column) -> Column:
    """True where all elements of a non-empty array are equal (NaN equals NaN, NULL equals NULL).

    Most channels of a day are empty, so most day arrays repeat one value. Telling that runs as generated code, where a
    lambda is called element by element; the functions below call theirs once for such an array. The comparison with the
    repeated first element hashes nothing and ends at the first other one.
    """
    n = F.size(values)
    return F.coalesce((n > 0) & (values == F.array_repeat(F.get(values, F.lit(0)), n)), F.lit(False))


def mapped(values: Column | str, f) -> Column:
    """``transform`` by a function of the element alone."""
    values = F.col(values) if isinstance(values, str) else values
    once = F.array_repeat(f(F.get(values, F.lit(0))), F.size(values))
    return F.when(is_constant(values), once).otherwise(F.transform(values, f))


def zipped(left: Column | str, right: Column | str, f) -> Column:
    """``zip_with`` by a function of the two elements alone."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    first = F.lit(0)
    alike = is_constant(a) & is_constant(b) & (F.size(a) == F.size(b))
    return F.when(alike, F.array_repeat(f(F.get(a, first), F.get(b, first)), F.size(a))).otherwise(F.zip_with(a, b, f))


def total(values: Column | str, f=lambda v: v, kind: str = "double") -> Column:
    """Sum of ``f`` over the elements, in ``kind``."""
    values = F.col(values) if isinstance(values, str) else values
    once = (f(F.get(values, F.lit(0))).cast(kind) * F.size(values)).cast(kind)
    summed = F.aggregate(values, F.lit(0).cast(kind), lambda a, v: a + f(v).cast(kind))
    return F.when(is_constant(values), once).otherwise(summed)


#: Cells that ``list_sums`` treats in one go, about: its temporary arrays stay small.
CELLS_SUMMED = 1 << 17


def list_sums(at_once: int = CELLS_SUMMED):
    """A function of arrays in tasks: ``SUMS`` of each list; NULL for a missing list and for one with a missing element."""

    def sums(arrays: pa.Array) -> pa.Array:
        reach, parts, at = np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), [], 0
        while at < len(arrays):
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + at_once, "right")))
            parts.append(slice_sums(arrays.slice(at, end - at)))
            at = end
        return pa.concat_arrays(parts) if parts else slice_sums(arrays)

    def slice_sums(arrays: pa.Array) -> pa.Array:
        cells, lengths = arrays.flatten(), arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        missing = np.asarray(arrays.is_null())
        found = np.zeros((3, len(lengths)))
        full = lengths > 0
        if full.any():
            sizes = lengths[full]
            starts = np.cumsum(sizes) - sizes
            if cells.null_count:
                missing[full] |= np.logical_or.reduceat(np.asarray(cells.is_null()), starts)
                cells = cells.fill_null(0)
            plain = cells.to_numpy(zero_copy_only=False).astype("float64")
            number = np.where(np.isnan(plain), 0.0, plain)
            place = np.arange(1, len(plain) + 1) - np.repeat(starts, sizes)
            found[:, full] = [np.add.reduceat(x, starts) for x in (plain, number, number * place)]
        fields = [pa.array(x, mask=missing) for x in found]
        return pa.StructArray.from_arrays(fields, ["plain", "total", "weighted"], mask=pa.array(missing))

    return sums


def with_sums(df: DataFrame, keep: list[str | Column], arrays: dict[str, str | Column]) -> DataFrame:
    """``keep`` and a struct of sums for each array: ``plain``, ``total`` and ``weighted`` by places from 1; in the last two
    NaN counts as zero. NULL for an array with a NULL.

    Arrays of one value are summed by their first element, others outside generated code, which calls a lambda for each.
    Only these go on to that, so the rows that wait for their sums stay small.
    """
    kept = df.select(*keep).columns
    columns, sums = [], F.arrow_udf(list_sums(), SUMS)
    for name, array in arrays.items():
        c = F.col(array) if isinstance(array, str) else array
        one, n = F.get(c, F.lit(0)).cast("double"), F.size(c).cast("double")
        number = F.nanvl(one, F.lit(0.0))
        once = F.struct((one * n).alias("plain"), (number * n).alias("total"), (number * (n * (n + 1) / 2)).alias("weighted"))
        alike = is_constant(c)
        columns += [F.when(alike & one.isNotNull(), once).alias(f"_once_{name}"), F.when(~alike, c).alias(f"_varied_{name}")]
    varied = lambda name: F.col(f"_varied_{name}")
    return df.select(*keep, *columns).select(
        *kept, *[F.when(varied(name).isNull(), F.col(f"_once_{name}")).otherwise(sums(varied(name))).alias(name) for name in arrays]
    )


def count_of_others(values: Column | str, value: Column) -> Column:
    """Number of elements that differ from ``value``; generated code."""
    return F.size(F.array_remove(values, value))


def with_cell_sums(df: DataFrame, keep: list[str | Column], values: str, name: str = "v") -> DataFrame:
    """``total`` and ``weighted`` of ``with_sums``, for long arrays of which few cells are neither zero nor NaN.

    Cells are listed and added up in generated code, and no array leaves it. Each row of ``df`` is a group of its own, also
    when rows repeat; where ``keep`` has the columns that rows were dealt by, they meet where they are.
    """
    c, kept = F.col(values), df.select(*keep).columns
    one, n = F.get(c, F.lit(0)).cast("double"), F.size(c).cast("double")
    number, alike = F.nanvl(one, F.lit(0.0)), is_constant(c)
    once = F.struct((number * n).alias("total"), (number * (n * (n + 1) / 2)).alias("weighted"))
    rows = df.select(
        *keep,
        F.when(alike & one.isNotNull(), once).alias("_once"),
        F.when(~alike, c).alias("_varied"),
        (c.isNull() | (alike & one.isNull())).alias("_gone"),
        F.monotonically_increasing_id().alias("_row"),
    )
    cells = rows.select(*kept, "_row", "_once", "_gone", F.posexplode_outer("_varied").alias("_at", "_cell"))
    cell, at = F.col("_cell").cast("double"), F.col("_at")
    # The first cell stays for the row's sake.
    listed = cells.where(at.isNull() | (at == 0) | cell.isNull() | ((cell != 0) & ~F.isnan(cell)))
    number = F.nanvl(cell, F.lit(0.0))
    sums = listed.groupBy(*kept, "_row", "_once", "_gone").agg(
        F.coalesce(F.sum(number), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(number * (at + 1)), F.lit(0.0)).alias("weighted"),
        F.count_if(at.isNotNull() & cell.isNull()).alias("_nulls"),
    )
    added = F.when(~F.col("_gone") & (F.col("_nulls") == 0), F.struct("total", "weighted"))
    return sums.select(*kept, F.coalesce("_once", added).alias(name))


def positions(length: Column) -> Column:
    """``[0, 1, ..., length-1]``; empty for a length of zero."""
    return F.when(length > 0, F.sequence(F.lit(0), (length - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def at(arr: Column, index: Column) -> Column:
    """Element at a zero-based index, NULL when out of range."""
    return F.when((index >= 0) & (index < F.size(arr)), F.get(arr, index.cast("int")))


def runs(flags: Column, min_length: int | Column) -> Column:
    """Maximal runs of true with at least ``min_length`` elements as ``array<struct<start,end>>``.

    ``end`` is exclusive. NULL elements count as false.
    """

    def find(flags):
        def on(i):
            return F.coalesce(at(flags, i), F.lit(False))

        index = positions(F.size(flags))
        starts = F.filter(index, lambda i: on(i) & ~on(i - 1))
        ends = F.transform(F.filter(index, lambda i: on(i) & ~on(i + 1)), lambda i: i + 1)
        pairs = F.zip_with(
            starts,
            ends,
            lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end")),
        )
        return F.filter(pairs, lambda r: (r["end"] - r["start"]) >= min_length)

    return let(flags, find)


def replace_runs(values: Column, run_list: Column, run_values) -> Column:
    """Replace each ``[start, end)`` run of ``values`` by ``run_values(run)`` (an array of that length)."""

    def build(values, run_list):
        n = F.size(run_list)

        def piece(run, i):
            previous = F.when(i > 0, F.get(run_list, i - 1)["end"]).otherwise(F.lit(0))
            return F.concat(
                cut(values, previous, run["start"] - previous),
                run_values(run),
            )

        tail = F.when(n > 0, F.get(run_list, n - 1)["end"]).otherwise(F.lit(0))
        return F.concat(
            F.flatten(F.transform(run_list, piece)),
            cut(values, tail, F.size(values) - tail),
        )

    return let(values, lambda v: let(run_list, lambda r: build(v, r)))


def observed(value: Column) -> Column:
    """True when a minute value is neither zero nor missing."""
    return F.coalesce((value != 0) & ~F.isnan(value), F.lit(False))


def nan_to(value: Column, replacement) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit(replacement)).otherwise(value)


def cut(values: Column, start: Column, length: Column) -> Column:
    """Zero-based slice for use inside a lambda, where ``slice`` would copy the whole array each time."""
    return F.transform(
        F.filter(positions(length), lambda i: start + i < F.size(values)),
        lambda i: F.get(values, (start + i).cast("int")),
    )
