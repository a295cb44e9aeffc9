"""Exact quantiles with linear interpolation, and the statistics that come with them, in three scans.

``percentile`` ships every distinct value of a group to one reducer. Here histograms are narrowed. The first scan counts
each group's values by the logarithm of their size (some 1400 buckets per factor e, so at most 4 million a group), the
second those of the buckets that hold a wanted rank by 2 million equal steps between the bucket's least and greatest
value, the third the values of the steps that hold one: a step has room for 2 million different doubles at most. So the
rows that meet after map-side counting are bounded whatever the size of a group and the spread of its values; nothing is
ranked row by row, and no bound is estimated.

It is one statement, so that Spark analyses it once. Scans find their buckets in a map that the scan before leaves as one row: groups are to be an enumeration (device class,
record type, split, column), and more than ``GROUPS`` of them are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups (of keys and columns) that one call narrows at once, at most.
GROUPS = 10_000
#: Buckets per factor e of the first scan; logarithms of doubles lie between -745 and 710.
PER_E = 1400
STEPS = 1 << 21
BASICS = ("n", "n_missing", "sum", "mean", "m2", "min", "max")

#: A number that rises with ``v``: Java's logarithm never falls where its argument rises.
SIZE_BUCKET = f"""CASE WHEN v = 0 THEN 0L WHEN abs(v) = double('infinity') THEN {1 << 40}L
ELSE floor((ln(abs(v)) + 746) * {PER_E}) + 1 END * CAST(signum(v) AS BIGINT)"""


def _held(rank: str, value: str) -> str:
    """``value`` of the one bucket that holds ``rank``."""
    return f"max(CASE WHEN {rank} >= before AND {rank} < before + n THEN {value} END)"


def _before(rows: str, by: str, order: str, more: str = "") -> str:
    """Buckets with the number of values in earlier ones of the same ``by``."""
    return f"SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - n AS before{more} FROM {rows}"


def _inside(groups: str) -> str:
    """Values in wanted buckets, which don't overlap, with their bucket; a group without values keeps its rows."""
    entries = "collect_list(struct(g, struct(s, w)))"
    many = f"CASE WHEN count(*) > {GROUPS} THEN raise_error('more than {GROUPS} groups') ELSE map_from_entries({entries}) END"
    return f"""SELECT * FROM (SELECT g, v, m, get(filter(m.w, w -> w.lo <= v AND v <= w.hi), 0) AS own
FROM (SELECT g, v, element_at((SELECT {many} FROM {groups}), g) AS m FROM data)) WHERE own IS NOT NULL OR m.s.n = 0"""


def _statement(probabilities: list[float], keys: int) -> str:
    ranks = [f"{side}((total - 1) * {float(p)!r}D)" for p in probabilities for side in ("floor", "ceil")]
    indices = range(len(ranks))
    bucket = "struct({rank} - before AS rank, lo, hi)"
    mine = lambda i: f"CASE WHEN get(m.w, {i}).lo = part THEN get(m.w, {i}).rank END"
    first = ", ".join(_held(r, bucket.format(rank=r)) for r in ranks)
    second = ", ".join(_held(mine(i), bucket.format(rank=mine(i))) for i in indices)
    third = ", ".join(_held(mine(i), "v") for i in indices)
    basics = """sum(n) AS n, sum(missing) AS n_missing, sum(s) AS sum, max(whole) AS mean,
sum(n * (var + (mean - whole) * (mean - whole))) AS m2, min(lo) AS min, max(hi) AS max"""
    whole = ", sum(n) OVER (PARTITION BY g) AS total, try_divide(sum(s) OVER (PARTITION BY g), sum(n) OVER (PARTITION BY g)) AS whole"

    def quantile(i: int, p: float) -> str:
        low, high, at = f"get(w, {2 * i})", f"get(w, {2 * i + 1})", f"((s.n - 1) * {float(p)!r}D)"
        between = f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * ({at} - floor({at})) END"
        return f"CASE WHEN {low} IS NULL AND s.n > 0 THEN raise_error('the rank of a quantile was not found') ELSE {between} END"

    quantiles = ", ".join(quantile(i, p) for i, p in enumerate(probabilities))
    columns = ", ".join([*(f"g.k{i} AS k{i}" for i in range(keys)), "g.variable AS variable"])
    ctes = {
        "data": f"SELECT struct({', '.join([*(f'k{i}' for i in range(keys)), 'variable'])}) AS g, CASE WHEN NOT isnan(x) THEN x + 0D END AS v FROM {{long}}",
        "sized": f"""SELECT g, {SIZE_BUCKET} AS b, count(v) AS n, count_if(v IS NULL) AS missing, sum(v) AS s, avg(v) AS mean,
var_pop(v) AS var, min(v) AS lo, max(v) AS hi FROM data GROUP BY ALL""",
        "sizes": _before("sized", "g", "b", whole),
        "groups1": f"SELECT g, struct({', '.join(BASICS)}) AS s, w FROM (SELECT g, {basics}, array({first}) AS w FROM sizes GROUP BY g)",
    }
    if ranks:
        ctes |= {
            "in1": _inside("groups1"),
            "stepped": f"""SELECT g, own.lo AS part, CASE WHEN own.hi > own.lo THEN floor((v - own.lo) / (own.hi - own.lo) * {STEPS}) ELSE 0L END AS b,
count(v) AS n, min(v) AS lo, max(v) AS hi, any_value(m) AS m FROM in1 GROUP BY ALL""",
            "steps": _before("stepped", "g, part", "b"),
            "groups2": f"SELECT g, any_value(m.s) AS s, array({second}) AS w FROM steps GROUP BY g",
            "in2": _inside("groups2"),
            "valued": "SELECT g, own.lo AS part, v, count(v) AS n, any_value(m) AS m FROM in2 GROUP BY ALL",
            "vals": _before("valued", "g, part", "v"),
            "groups3": f"SELECT g, any_value(m.s) AS s, array({third}) AS w FROM vals GROUP BY g",
        }
    last = "groups3" if ranks else "groups1"
    return (
        "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items())
        + f"\nSELECT {columns}, s.*, CAST(array({quantiles}) AS ARRAY<DOUBLE>) AS quantiles FROM {last}"
    )


def summaries(df: DataFrame, keys: list[str], columns: list[str], probabilities: list[float] = ()) -> DataFrame:
    """One row per group and column: keys, variable, n, n_missing, sum, mean, m2, min, max, quantiles.

    NULL and NaN are missing. ``m2`` is the sum of squared distances from the mean; ``quantiles`` follows
    ``probabilities`` (NULL entries in a group without values).
    """
    names = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    values = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns]
    long = df.select(*names, F.inline(F.array(*values)))
    out = df.sparkSession.sql(_statement(list(probabilities), len(keys)), long=long)
    return out.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """One row per group and probability: ``keys, probability, quantile``. NULL and NaN are ignored."""
    listed = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("probability"), F.col("quantiles").alias("quantile"))
    out = summaries(df, keys, [value], probabilities).where("n > 0")
    return out.select(*keys, F.explode(listed).alias("_q")).select(*keys, F.col("_q.probability").alias("probability"), F.col("_q.quantile").alias("quantile"))
