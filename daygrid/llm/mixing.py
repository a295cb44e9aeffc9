"""Mixing to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Their tokens, counted by the tokenizer of the packing and with
the end id, are summed per cell in one pass and raked until source, language and topic each have their target share of
``keep`` of the whole, no cell above its present weight; raked over present weight is the inclusion probability. Targets
that need more than there is are not reached: ``fit`` returns target and reached share per margin. Documents are then
kept by a hash of their id against their cell's probability, row by row, so the same rows are kept on every run.

Only cells reach the driver. Values without a target of their own share the entry ``OTHER``, so there are at most as
many cells as the targets, a parameter, have combinations, however large the corpus is.

Defined cases: null source or language and unlisted values are ``OTHER``; a null text weighs its end id and is ``general``;
repeated rows weigh and are kept alike; a null id hashes like the text ``~``; targets of absent values are spread over
the present ones; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.llm import packing
from daygrid.llm.common import fresh, stored

OTHER = "(other)"
ROUNDS = 200
TOLERANCE = 1e-9
#: A cell this many times over its weight is full for good; bounds the factors where targets contradict each other.
FULL = 1e12
#: Distance of a reached share from its target that is logged.
REPORTED = 1e-4
DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """Target shares per dimension; they need not sum to 1. ``keep``: expected share of all weight that stays."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    keep: float
    seed: str = "mix-1"


#: Production targets: the dominant source is halved, small languages and special topics are raised.
PRODUCTION = Targets(
    source={"src0": 0.2, **{f"src{i}": 0.04 for i in range(1, 20)}, OTHER: 0.04},
    lang={"en": 0.6, "de": 0.14, "fr": 0.14, "es": 0.1, OTHER: 0.02},
    topic={"general": 0.85, "numbers": 0.05, "contact": 0.05, "legal": 0.05},
    keep=0.7,
)


def topic_of(text: Column) -> Column:
    """What a text is about, by plain marks in it."""
    lower = F.lower(text)
    return (
        F.when(lower.contains("licen") | lower.contains("copyright"), "legal")
        .when(text.contains("@") | text.contains("://"), "contact")
        .when(text.rlike("[0-9]{2}"), "numbers")
        .otherwise("general")
    )


def _cell(name: str, shares: dict[str, float]) -> Column:
    listed = [v for v in shares if v != OTHER]
    return F.when(F.col(name).cast("string").isin(listed), F.col(name).cast("string")).otherwise(OTHER)


def _level(base: np.ndarray, cap: np.ndarray, goal: float) -> float:
    """The factor at which ``min(cap, factor x base)`` sums to ``goal``, or reaches every cap."""
    there = base > 0
    base, cap = base[there], cap[there]
    if not goal or not len(base):
        return 0.0
    full = cap / base  # the factor that fills a cell
    order = np.argsort(full)
    base, cap, full = base[order], cap[order], full[order]
    held = np.concatenate([[0.0], np.cumsum(cap)[:-1]])
    free = np.cumsum(base[::-1])[::-1]
    sums = held + full * free  # what the slice holds at each of these factors
    at = int(np.searchsorted(sums, goal))
    return float(full[-1] if at == len(full) else (goal - held[at]) / free[at])


def _sums(table: np.ndarray, axis: int) -> np.ndarray:
    return table.sum(tuple(i for i in range(table.ndim) if i != axis))


def rake(weights: np.ndarray, shares: list[np.ndarray], rounds: int = ROUNDS, keep: float | None = None) -> np.ndarray:
    """Fit a contingency table to marginal shares; empty slices get nothing, their share goes to the others.

    With ``keep``, ``keep`` of the whole is fitted and no cell gets more than its present weight: full cells are held
    there and the others of the slice are raised to its goal, in every step. A slice whose goal is more than it has is
    taken whole; what it lacks is spread over the other slices in proportion to their targets.
    """
    total = weights.sum() * (1.0 if keep is None else keep)
    fitted = weights.astype(float).copy()
    if not total:
        return fitted
    cap = np.full(weights.shape, np.inf) if keep is None else fitted.copy()
    goals = []
    for axis, share in enumerate(shares):
        present = _sums(weights, axis)
        goal = np.where(present > 0, share, 0.0)
        if not goal.sum():
            goal = (present > 0).astype(float)
        if keep is None:
            goals.append(goal / goal.sum() * total)
        else:
            goals.append(np.minimum(present, goal * _level(goal, present * (goal > 0), total)))
    base = fitted
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(goals):
            now = _sums(np.minimum(base, cap), axis)
            worst = max(worst, float(np.abs(goal - now).max()) / total)
            if keep is None:
                factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            else:
                factor = np.array([_level(np.take(base, i, axis).ravel(), np.take(cap, i, axis).ravel(), g) for i, g in enumerate(goal)])
            base = base * factor.reshape([-1 if i == axis else 1 for i in range(weights.ndim)])
            if keep is not None:
                base = np.minimum(base, FULL * cap)
        if worst < TOLERANCE:
            break
    return np.minimum(base, cap)


@dataclass(frozen=True)
class Margin:
    """Shares of one value: in the whole, as the targets ask (0 without one), and expected in what is kept."""

    dimension: str
    value: str
    present: float
    target: float
    reached: float


@dataclass(frozen=True)
class Fit:
    """Probability of every cell that occurs, the share of all weight expected to stay, and how near the targets are."""

    probability: dict[tuple[str, str, str], float]
    keep: float
    margins: list[Margin]


def probabilities(weights: np.ndarray, fitted: np.ndarray, keep: float) -> np.ndarray:
    """Inclusion probability per cell: min(1, level x fitted / present), expected weight ``keep`` of the whole."""
    ratio = np.divide(fitted, weights, out=np.zeros_like(fitted), where=weights > 0)
    goal = keep * weights.sum()
    low, high = 0.0, 1.0
    reachable = weights[ratio > 0].sum()
    if goal >= reachable:
        return np.where(ratio > 0, 1.0, 0.0)
    while (weights * np.minimum(1, high * ratio)).sum() < goal:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (weights * np.minimum(1, mid * ratio)).sum() < goal else (low, mid)
    return np.minimum(1, high * ratio)


def in_cells(docs: DataFrame, targets: Targets, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with cell columns under free names."""
    names = {n: fresh(docs, f"mix_{n}") for n in DIMENSIONS}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            names["source"]: _cell("source", targets.source),
            names["lang"]: _cell("lang", targets.lang),
            names["topic"]: topic_of(text),
        }
    ), names


def weighed(docs: DataFrame, targets: Targets, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with cell columns and weight (tokens that packing makes of the text) under free names."""
    rows, names = in_cells(docs, targets, text_col)
    names["weight"] = fresh(rows, "mix_weight")
    return rows.withColumn(names["weight"], packing.n_tokens(F.col(text_col).cast("string"))), names


def fit(rows: DataFrame, names: dict[str, str], targets: Targets = PRODUCTION) -> Fit:
    """The mix of ``rows``, which ``weighed`` has made; targets that the rows cannot reach are logged."""
    values = [list(dict.fromkeys([*getattr(targets, d), OTHER])) for d in DIMENSIONS]
    cells = rows.groupBy(*[names[d] for d in DIMENSIONS]).agg(F.sum(names["weight"]).alias("w"))
    found = {tuple(r)[:3]: r["w"] for r in cells.collect()}
    weights = np.zeros([len(v) for v in values])
    place = [{x: i for i, x in enumerate(v)} for v in values]
    for cell, w in found.items():
        weights[tuple(p[x] for p, x in zip(place, cell, strict=True))] = w
    shares = [np.array([getattr(targets, d).get(x, 0.0) for x in v]) for d, v in zip(DIMENSIONS, values, strict=True)]
    p = probabilities(weights, rake(weights, shares, keep=targets.keep), targets.keep)
    kept, margins = weights * p, []
    for axis, (d, share) in enumerate(zip(DIMENSIONS, shares, strict=True)):
        for i, value in enumerate(values[axis]):
            part = lambda t: float(_sums(t, axis)[i] / t.sum()) if t.sum() else 0.0  # noqa: B023, E731
            margins.append(Margin(d, value, part(weights), float(share[i] / share.sum()) if share.sum() else 0.0, part(kept)))
    missed = [f"{m.dimension} {m.value}: {m.reached:.4f} of {m.target:.4f}" for m in margins if abs(m.reached - m.target) > REPORTED]
    if found and missed:
        logging.getLogger(__name__).warning("mix: shares reached of targets at keep %s: %s", targets.keep, "; ".join(missed))
    probability = {cell: float(p[tuple(q[x] for q, x in zip(place, cell, strict=True))]) for cell in found}
    return Fit(probability, float(kept.sum() / weights.sum()) if found else 0.0, margins)


def _drawn(
    rows: DataFrame, names: dict[str, str], cells: dict[tuple[str, str, str], float], targets: Targets, id_col: str
) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with their cells' ``probability`` and ``kept`` under free names."""
    names = {**names, "probability": fresh(rows, "mix_probability"), "kept": fresh(rows, "mix_kept")}
    # As many rows as the targets have combinations: bounded by a parameter.
    listed = rows.sparkSession.createDataFrame(
        [(*k, v) for k, v in sorted(cells.items())], "mix_s string, mix_l string, mix_t string, mix_p double"
    )
    listed = listed.select(*[F.col(c).alias("cell_" + names[d]) for c, d in zip(("mix_s", "mix_l", "mix_t"), DIMENSIONS, strict=True)], F.col("mix_p").alias(names["probability"]))
    on = [rows[names[d]] == listed["cell_" + names[d]] for d in DIMENSIONS]
    rows = rows.join(F.broadcast(listed), on, "left").drop(*["cell_" + names[d] for d in DIMENSIONS])
    digest = F.md5(F.concat(F.lit(targets.seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("~"))))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
    return rows.withColumn(names["kept"], F.coalesce(draw < F.col(names["probability"]), F.lit(False))), names


def with_probability(
    docs: DataFrame, targets: Targets = PRODUCTION, id_col: str = "doc_id", columns: list[str] | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with cell columns, weight, ``probability`` and ``kept`` under free names (returned).

    Tokens are counted once, so the rows are stored; ``columns`` of ``docs`` come along, all where unset.
    """
    rows, names = weighed(docs, targets)
    own = [F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]
    rows = stored(rows.select(*own, *names.values()), "mix-weights")
    return _drawn(rows, names, fit(rows, names, targets).probability, targets, id_col)


def sample(docs: DataFrame, targets: Targets = PRODUCTION, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with their own columns; the second pass needs cells only, no tokens."""
    cells = fit(*weighed(docs, targets), targets).probability
    rows, names = _drawn(*in_cells(docs, targets), cells, targets, id_col)
    return rows.filter(F.col(names["kept"])).select(*[F.col(f"`{c}`") for c in docs.columns])
