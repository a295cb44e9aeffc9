"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.catalog.sql import with_ctes
from daygrid.functions import arrays as A
from daygrid.sources.session import pin_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the shared CTEs by name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_session(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return run

    return register


def nudge(digits: int) -> float:
    """Moves exact decimal ties to one side, so both engines round them alike."""
    return 1.3 * 10.0 ** -(digits + 3)


def rounded(column: Column | str, digits: int = 6) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + F.lit(nudge(digits)), digits)


def position_sums(values: Column) -> Column:
    """Struct of the sum of an array's values and of their products with their positions from 1; NaN counts as zero."""
    number = lambda v: F.nanvl(v.cast("double"), F.lit(0.0))
    placed = F.transform(values, lambda v, i: number(v) * (i + 1))
    summed = F.struct(
        F.aggregate(values, F.lit(0.0), lambda a, v: a + number(v)).alias("total"),
        F.aggregate(placed, F.lit(0.0), lambda a, v: a + v).alias("weighted"),
    )
    one, n = F.nanvl(F.get(values, F.lit(0)).cast("double"), F.lit(0.0)), F.size(values).cast("double")
    once = F.struct((one * n).alias("total"), (one * (n * (n + 1) / 2)).alias("weighted"))
    return F.when(A.is_constant(values), once).otherwise(summed)


def rounded_all(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[
            rounded(c, digits).alias(c) if t in ("double", "float") and c not in skip else F.col(c)
            for c, t in df.dtypes
        ]
    )
