"""Whitening of embeddings along their leading principal components, which spectrum slicing isolates and numbers.

Entries c become integers x = floor(1024 c) + 100000, so counts, sums and products are exact whatever the order of tasks:
the second pass multiplies x less the nearest integer to its mean, in limbs whose products a double holds exactly, and
the covariance n * G - T T' over n^2 is formed from whole numbers and rounded once.

The covariance V, as wide as a vector, is all that reaches the driver. How many eigenvalues lie above a shift s is the
number of positive pivots of the LDL' factors of V - s I (Sylvester's law of inertia). Bisection by these counts isolates
the k-th largest eigenvalue; Rayleigh quotient iteration from there converges cubically, each step by the factors of its
own shift, whose count narrows the interval too. A vector is accepted when its residual is down to rounding and the
counts on both sides of its eigenvalue say that it is the k-th. Eigenvalues closer than rounding are one cluster: the
counts certify the cluster, and each new vector is kept orthogonal to those found.

Four scans of one column, no shuffle but of partial sums: the squares of the dimension, a row each a task.

Defined cases: vectors that are null, empty or hold a null, an infinity, a NaN or an entry beyond 2^42 (the integers would
not be exact in a double) are left out, as are those of another length than most have (of equally common ones the
longest); repeated rows count each; ids may be null; an empty table gives an empty result. Components whose eigenvalue is
zero, to rounding, have explained 0 and no whitened value; where all vectors are equal explained is null as well.
Columns other than the id and the vector are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries beyond are not usable: x would not be exact as a double.
MOST = float(1 << 42)
#: Bits of a limb: products of two limbs, summed over ``ROWS`` rows, stay below 2^53.
LIMB = 20
ROWS = 8192
EPS = float(np.finfo(float).eps)


def integers(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Places of usable vectors by length, and their x: {length: rows x length}; only ``dim`` if given."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(np.asarray(lists.offsets, np.int64))
    valid = ~np.asarray(lists.is_null())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    places, out = {}, {}
    for d in np.unique(sizes[valid & (sizes > 0)]) if dim is None else [dim]:
        at = np.flatnonzero(valid & (sizes == d))
        rows = flat[starts[at][:, None] + np.arange(d)]
        good = (np.abs(rows) < MOST).all(axis=1)  # false for NaN, which nulls become, and infinities
        if good.any():
            places[int(d)] = at[good]
            out[int(d)] = np.floor(SCALE * rows[good]).astype(np.int64) + SHIFT
    return places, out


def _task(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], names: list[str]):
    """A function for ``mapInArrow`` that yields one batch of rows per dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names)

    return run


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of usable vectors of the most common length, and their sum in each dimension."""

    def partial(batches):
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for d, x in integers(batch.column(0))[1].items():
                # Halves of x, so that sums of longs can't overflow.
                high, low = (x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist()
                total[d, -1] = total.get((d, -1), 0) + len(x)
                for j in range(d):
                    total[d, j] = total.get((d, j), 0) + (high[j] << 26) + low[j]
        keys = list(total)
        yield {
            "d": [k[0] for k in keys] + [0], "j": [k[1] for k in keys] + [0], "v": [str(total[k]) for k in keys] + ["0"]
        }

    rows = vectors.mapInArrow(_task(partial, ["d", "j", "v"]), "d long, j long, v string")
    rows = stored(rows.groupBy("d", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")), "sums")
    top = rows.filter("j = -1").orderBy(F.desc("v"), F.desc("d")).limit(1).collect()
    if not top:
        return 0, []
    own = {r["j"]: int(r["v"]) for r in rows.filter(F.col("d") == top[0]["d"]).collect()}
    return own.pop(-1), [own[j] for j in range(len(own))]


def products(vectors: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums over all usable vectors of the products of entries i <= j, each less its centre."""
    d = len(centre)
    upper = np.triu_indices(d)

    def flushed(total: dict[int, np.ndarray]) -> dict:
        digits = list(total)
        return {
            "digit": np.repeat(np.array(digits, np.int64), len(upper[0])),
            "cell": np.tile(upper[0] * d + upper[1], len(digits)),
            "v": np.concatenate([total[s][upper] for s in digits]) if digits else np.empty(0, np.int64),
        }

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        blocks = 0
        for batch in batches:
            x = integers(batch.column(0), d)[1].get(d, np.empty((0, d), np.int64)) - np.array(centre, np.int64)
            for at in range(0, len(x), ROWS):
                y, limbs = x[at : at + ROWS], []
                while not limbs or y.any():
                    if np.abs(y).max() < 1 << LIMB:  # the last limb has the sign
                        limbs.append(y.astype(float))
                        break
                    limbs.append((y & (1 << LIMB) - 1).astype(float))
                    y = y >> LIMB
                for a, left in enumerate(limbs):
                    for b, right in enumerate(limbs):
                        total[a + b] = total.get(a + b, 0) + (left.T @ right).astype(np.int64)
                blocks += 1
                if blocks == 128:  # at most 2^53 each, four pairs of limbs to a digit: below 2^63
                    yield flushed(total)
                    total, blocks = {}, 0
        yield flushed(total)

    rows = vectors.mapInArrow(_task(partial, ["digit", "cell", "v"]), "digit long, cell long, v long")
    cells = rows.groupBy("digit", "cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toLocalIterator()
    out: dict[tuple[int, int], int] = {}
    for r in cells:
        at = divmod(r["cell"], d)
        out[at] = out.get(at, 0) + (int(r["v"]) << LIMB * r["digit"])
    return out


class Factors:
    """LDL' of a symmetric matrix with pivots of one or two rows (Bunch and Kaufman): inertia and solutions."""

    GROWTH = (1 + sqrt(17)) / 8

    def __init__(self, matrix: np.ndarray):
        a, n = matrix.copy(), len(matrix)
        self.order, self.pivots, self.positive = np.arange(n), [], 0
        least = EPS * max(float(np.abs(a).max(initial=0)), 1e-300)
        k = 0
        while k < n:
            column = np.abs(a[k + 1 :, k])
            r = k + 1 + int(column.argmax()) if len(column) else k
            off, two = float(column.max(initial=0)), False
            if abs(a[k, k]) < self.GROWTH * off:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                widest = float(row.max())
                if abs(a[k, k]) * widest >= self.GROWTH * off * off:
                    pass
                elif abs(a[r, r]) >= self.GROWTH * widest:
                    self._swap(a, k, r)
                else:
                    self._swap(a, k + 1, r)
                    two = True
            size = 2 if two else 1
            block = a[k : k + size, k : k + size].copy()
            if not two and abs(block[0, 0]) < least:
                block[0, 0] = -least  # an eigenvalue at the shift counts as not above it
            below = a[k + size :, k : k + size].copy()
            a[k + size :, k : k + size] = below @ np.linalg.inv(block)
            a[k + size :, k + size :] -= a[k + size :, k : k + size] @ below.T
            self.pivots.append((k, size, block))
            self.positive += 1 if two else int(block[0, 0] > 0)  # a pivot of two rows has one eigenvalue of each sign
            k += size
        self.lower = a

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b[self.order].copy()
        for k, size, block in self.pivots:
            y[k + size :] -= self.lower[k + size :, k : k + size] @ y[k : k + size]
        for k, size, block in self.pivots:
            y[k : k + size] = np.linalg.solve(block, y[k : k + size])
        for k, size, _ in reversed(self.pivots):
            y[k : k + size] -= self.lower[k + size :, k : k + size].T @ y[k + size :]
        out = np.empty_like(y)
        out[self.order] = y
        return out


@dataclass
class Spectrum:
    """Leading eigenvalues and unit eigenvectors of a symmetric matrix, by slicing."""

    matrix: np.ndarray
    values: list[float] = field(default_factory=list)
    vectors: list[np.ndarray] = field(default_factory=list)
    counts: dict[float, int] = field(default_factory=dict)

    def __post_init__(self):
        self.n = len(self.matrix)
        radius = np.abs(self.matrix).sum(axis=1) - np.abs(self.matrix.diagonal())
        self.size = max(float((np.abs(self.matrix.diagonal()) + radius).max()), 1e-300)
        self.near = 16 * self.n * EPS * self.size
        self.counts[-1.01 * self.size - self.near], self.counts[1.01 * self.size + self.near] = self.n, 0

    def factors(self, shift: float) -> Factors:
        found = Factors(self.matrix - shift * np.eye(self.n))
        self.counts[shift] = found.positive
        return found

    def above(self, shift: float) -> int:
        """How many eigenvalues lie above ``shift``."""
        if shift not in self.counts:
            self.factors(shift)
        return self.counts[shift]

    def interval(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that the k-th largest eigenvalue lies in."""
        return max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k)

    def isolated(self, k: int) -> tuple[float, float]:
        """Bisect until the k-th eigenvalue is alone, or its neighbours are closer than rounding."""
        low, high = self.interval(k)
        while self.counts[low] - self.counts[high] > 1 and high - low > self.near:
            self.above((low + high) / 2)
            low, high = self.interval(k)
        return low, high

    def _orthogonal(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for v in self.vectors:
                x = x - (v @ x) * v
        return x / np.linalg.norm(x)

    def _iterated(self, k: int, low: float, high: float) -> tuple[float, np.ndarray, float]:
        """Rayleigh quotient iteration, kept inside the interval: value, vector, residual."""
        x = self._orthogonal(np.random.default_rng(k).standard_normal(self.n))
        shift, best = (low + high) / 2, (0.0, x, np.inf)
        for step in range(40):
            solved = self.factors(shift).solve(x)
            if not np.isfinite(solved).all() or not solved.any():
                break
            x = self._orthogonal(solved / np.abs(solved).max())
            value = float(x @ self.matrix @ x)
            residual = float(np.linalg.norm(self.matrix @ x - value * x))
            if residual < best[2]:
                best = (value, x, residual)
            elif step > 2 and best[2] <= self.near:
                break
            # The first steps stay at the middle; then the quotient is the shift, where it lies in the interval.
            if step and low <= value <= high:
                shift = value
        return best

    def next(self) -> None:
        """Find the next smaller eigenvalue and its vector, certified by counts."""
        k = len(self.values) + 1
        while True:
            low, high = self.isolated(k)
            value, x, residual = self._iterated(k, low, high)
            margin = 4 * self.near + 2 * residual
            if residual <= self.near and self.above(value - margin) >= k and self.above(value + margin) < k:
                self.values.append(value)
                self.vectors.append(x)
                return
            low, high = self.interval(k)
            if high - low <= self.near:
                raise ArithmeticError(f"eigenvalue {k} can't be certified: residual {residual} at {value}")
            self.above((low + high) / 2)


def leading(matrix: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``number`` largest eigenvalues, falling, and their vectors as rows; the largest entry of each is positive."""
    found = Spectrum(matrix)
    for _ in range(min(number, len(matrix))):
        found.next()
    vectors = np.array([v * (1 if v[np.abs(v).argmax()] > 0 else -1) for v in found.vectors])
    return np.array(found.values), vectors.reshape(-1, len(matrix))


@dataclass
class Fit:
    """What whitening needs to know of all vectors; its size follows their length, not their number."""

    n: int
    centre: list[int]  # nearest integers to the mean
    rest: list[int]  # sums of x less the centre
    values: list[float | None]  # eigenvalues, nothing where zero to rounding
    vectors: np.ndarray
    explained: list[float | None]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of y = x less the centre, projected; NaN where an eigenvalue is zero."""
        scale = np.array([np.nan if e is None else 1 / sqrt(e) for e in self.values])
        return ((y - np.array(self.rest, float) / self.n) @ self.vectors.T) * scale


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Fit on all usable vectors of a one-column table; nothing where there is none."""
    n, total = sums(vectors)
    if not n:
        return None
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]
    d, cells = len(total), products(vectors, centre)
    whole = {(i, j): n * v - rest[i] * rest[j] for (i, j), v in cells.items()}
    matrix = np.array([[whole[min(i, j), max(i, j)] / n**2 for j in range(d)] for i in range(d)])
    trace = sum(whole[i, i] for i in range(d)) / n**2
    m = min(components, d)
    if not trace:
        return Fit(n, centre, rest, [None] * m, np.eye(m, d), [None] * m)
    found, axes = leading(matrix, m)
    values = [float(e) if e > d * EPS * trace * 16 else None for e in found]
    return Fit(n, centre, rest, values, axes, [0.0 if e is None else e / trace for e in values])


def identity_error(vectors: DataFrame, model: Fit) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity; nothing without components."""
    used = [k for k, e in enumerate(model.values) if e is not None]
    d, m = len(model.centre), len(used)
    if not used:
        return None

    def partial(batches):
        total = np.zeros((m + 1, m))
        for batch in batches:
            for x in integers(batch.column(0), d)[1].values():
                w = model.whitened(x - np.array(model.centre, np.int64))[:, used]
                total[:m] += w.T @ w
                total[m] += w.sum(axis=0)
        yield {"cell": np.arange(total.size), "v": total.ravel()}

    rows = vectors.mapInArrow(_task(partial, ["cell", "v"]), "cell long, v double")
    total = np.zeros((m + 1) * m)
    for r in rows.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        total[r["cell"]] = r["v"]
    total = total.reshape(m + 1, m) / model.n
    # The rows are centred already; what is left of their mean is rounding.
    return float(np.abs(total[:m] - np.outer(total[m], total[m]) - np.eye(m)).max())


def whiten(
    rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation (decimal), whitened, explained,
    identity_error, eigenvalue."""
    source = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = source.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double, eigenvalue double"
    )
    model = fit(source.select("vector"), components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(source.select("vector"), model)
    m, d = len(model.values), len(model.centre)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found = integers(batch.column(1), d)
            if d not in found:
                continue
            y = found[d] - np.array(model.centre, np.int64)
            spread = max(1, int(np.abs(y).max())) * model.n + max(map(abs, model.rest))
            exact = np.int64 if spread * spread * d < 1 << 63 else object
            each = model.n * y.astype(exact) - np.array(model.rest, exact)
            deviation = [Decimal(int(v)) for v in (each * each).sum(axis=1)]
            w = model.whitened(y)
            times = np.repeat(np.arange(len(y)), m)
            again = lambda values, t: pa.array(list(values) * len(y), t)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(places[d][times])),
                    again(range(1, m + 1), pa.int32()),
                    again([model.n] * m, pa.int64()),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(times)),
                    pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())),
                    again(model.explained, pa.float64()),
                    again([error] * m, pa.float64()),
                    again(model.values, pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
            )

    return source.mapInArrow(project, schema)
