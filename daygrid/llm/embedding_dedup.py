"""Near-duplicate embeddings by spherical-cap filters.

Filters are directions from structured random product codes: a random rotation, then one of a few random words per
block of coordinates; a direction is one word from each block, so a small code stands for a great many directions. A
vector is decoded to the list of *all* directions whose cosine with it exceeds a level. Vectors of one label that share
a direction are compared by cosine in double precision. Lists of a single code vary much in length; several codes with
rotations of their own even this out. The README gives the measured recall.

Equal vectors of a label are one class with a number of copies and are never paired. Classes meet per (label, direction)
in blocks of about ``BLOCK``; a task compares two blocks by matrix product and returns, per class, the number of links
found and the smallest class it reaches, never pairs. A pair that shares several directions counts at the smallest one.

Defined cases: a null label, a null or empty vector, null or non-finite components and the zero vector link with
nothing; vectors of different length are not compared; repeated rows are copies of each other; ids may repeat, every row
gets a row; ``component_id`` of a row without links is its own id; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.llm import graph
from daygrid.llm.common import stored

COSINE = 0.98
#: Codes, each with a rotation of its own; directions of a code that a vector exceeds, on average.
CODES, LIST = 20, 8
#: Share of all vectors above a direction's level: at most this, and so that few unrelated vectors of a label meet.
SHARE, CROWD = 3e-5, 0.25
#: Coordinates are cut into so many blocks; no level is above the highest (a cap must be wider than a link is long).
PARTS, HIGHEST = 4, 0.85
SEED = 20240
BLOCK = 1024
ROWS_AT_ONCE = 512
#: Rows of directions with a single block that one task compares, about.
ROWS_PER_TASK = 20_000


class Code:
    """One product code for vectors of one length, dense enough for ``population`` vectors of a label."""

    def __init__(self, dim: int, population: int, number: int):
        rng = np.random.default_rng([SEED, dim, number])
        share = min(SHARE, CROWD / max(population, 1))
        self.level = min(HIGHEST, NormalDist().inv_cdf(1 - share) / np.sqrt(dim))
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.blocks = np.array_split(np.arange(dim), min(PARTS, dim))
        probe = rng.normal(size=(64, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        size = 2
        while True:
            words = [rng.normal(size=(size, len(b))) for b in self.blocks]
            self.words = [w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(len(words)) for w in words]
            if len(self.decode(probe)[0]) >= LIST * len(probe):
                break
            size = max(size + 1, size * 9 // 8)

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All directions whose cosine with a row of ``units`` exceeds the level: (row, number of the direction).

        Block by block, partial directions are dropped that even the best remaining words cannot lift above the level.
        """
        turned = units @ self.rotation.T
        scores = [turned[:, b] @ w.T for w, b in zip(self.words, self.blocks, strict=True)]
        rest = np.zeros(len(units))
        bounds = []
        for s in scores[::-1]:
            bounds.append(rest)
            rest = rest + s.max(1)
        row, total, number = np.arange(len(units)), np.zeros(len(units)), np.zeros(len(units), np.int64)
        for s, bound in zip(scores, bounds[::-1], strict=True):
            sums = total[:, None] + s[row]
            at, word = np.nonzero(sums + bound[row][:, None] > self.level)
            row, total, number = row[at], sums[at, word], number[at] * s.shape[1] + word
        return row, number


def directions(units: np.ndarray, codes: list[Code]) -> list[np.ndarray]:
    """The sorted directions of each row over all codes; a code's number stands in the high bits."""
    rows, numbers = [], []
    for k, code in enumerate(codes):
        row, number = code.decode(units)
        rows.append(row)
        numbers.append(number + (k << 48))
    row, number = np.concatenate(rows), np.concatenate(numbers)
    order = np.lexsort((number, row))
    return np.split(number[order], np.cumsum(np.bincount(row, minlength=len(units)))[:-1])


def usable(embedding: str = "embedding", label: str = "label") -> Column:
    e = F.col(embedding)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(
        F.col(label).isNotNull() & e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0), F.lit(False)
    )


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one width, none of their components null, as unit rows in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def decoded(classes: DataFrame, population: int) -> DataFrame:
    """(cid, label, dim, direction) for every direction of every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[Code]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                vectors = part.column(2)
                dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
                for dim in map(int, np.unique(dims)):
                    if dim not in codes:
                        codes[dim] = [Code(dim, population, k) for k in range(CODES)]
                    own = np.flatnonzero(dims == dim)
                    lists = directions(_matrix(vectors.take(pa.array(own))), codes[dim])
                    again = pa.array(np.repeat(own, [len(d) for d in lists]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(again),
                            part.column(1).take(again),
                            pa.array(np.full(len(again), dim, np.int32)),
                            pa.array(np.concatenate(lists)),
                        ],
                        ["cid", "label", "dim", "direction"],
                    )

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("cid", "label", "vector").mapInArrow(run, f"cid long, label {label}, dim int, direction long")


def _reach(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (class, smaller class) that connect what ``linked`` (a x b) connects."""
    left, right = a.copy(), b.copy()
    while True:
        from_right = np.where(linked, right[None], np.iinfo(np.int64).max).min(1)
        new_left = np.minimum(left, from_right)
        from_left = np.where(linked, new_left[:, None], np.iinfo(np.int64).max).min(0)
        new_right = np.minimum(right, from_left)
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    return [(int(x), int(m)) for x, m in {*zip(a, left, strict=True), *zip(b, right, strict=True)} if x != m]


def _links(x: np.ndarray, lists: list[np.ndarray], direction: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows a link with which rows b; pairs that also share a smaller direction count there."""
    linked = x[a] @ x[b].T >= COSINE
    linked[a[:, None] == b[None]] = False
    if linked.any():
        rows = np.union1d(a, b)
        smaller = [lists[r][: np.searchsorted(lists[r], direction)] for r in rows]
        every = np.concatenate(smaller).astype(np.int64)
        who = np.repeat(np.arange(len(rows)), [len(d) for d in smaller])
        _, place, times = np.unique(every, return_inverse=True, return_counts=True)
        often = times > 1
        column = np.cumsum(often) - 1
        ok = often[place]
        has = np.zeros((len(rows), int(often.sum())), np.float32)
        has[who[ok], column[place[ok]]] = 1
        linked &= has[np.searchsorted(rows, a)] @ has[np.searchsorted(rows, b)].T == 0
    return linked


def compare(group: pa.Table) -> pa.Table:
    """Links of one task: two blocks at one direction, or all rows of many directions that are one block each.

    Rows (cid, links, other): links found, or another class it reaches.
    """
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    direction, block = np.array(group.column("direction")), np.array(group.column("block"))
    cid, copies = np.array(group.column("cid")), np.array(group.column("copies"))
    x = _matrix(group.column("vector").combine_chunks())
    shared = group.column("directions").combine_chunks()
    lists = np.split(shared.flatten().to_numpy(), np.cumsum(pc.list_value_length(shared).to_numpy())[:-1])
    n, pairs = np.zeros(len(cid), np.int64), []
    order = np.lexsort((cid, direction))
    cuts = np.flatnonzero(np.diff(direction[order])) + 1
    sizes = np.diff(np.concatenate([[0], cuts, [len(order)]]))
    if i == j:
        # Most directions hold two unrelated vectors: these are compared all at once.
        first = np.cumsum(sizes)[sizes == 2] - 2
        a, b = order[first], order[first + 1]
        for p, q in zip(*(r[np.einsum("ij,ij->i", x[a], x[b]) >= COSINE] for r in (a, b)), strict=True):
            if np.intersect1d(lists[p], lists[q])[0] == direction[p]:
                n[p] += copies[q]
                n[q] += copies[p]
                pairs.append((int(max(cid[p], cid[q])), int(min(cid[p], cid[q]))))
    for rows in np.split(order, cuts):
        if i == j and len(rows) < 3:
            continue
        a, b = (rows, rows) if i == j else (rows[block[rows] == i], rows[block[rows] == j])
        linked = _links(x, lists, direction[rows[0]], a, b)
        if linked.any():
            n[a] += linked @ copies[b]
            if i != j:
                n[b] += linked.T @ copies[a]
            pairs += _reach(linked, cid[a], cid[b])
    hit = np.flatnonzero(n)
    pairs = list(dict.fromkeys(pairs))
    return pa.table(
        {
            "cid": pa.array([*cid[hit].tolist(), *(p for p, _ in pairs)], pa.int64()),
            "links": pa.array([*n[hit].tolist(), *(0 for _ in pairs)], pa.int64()),
            "other": pa.array([*(None for _ in hit), *(q for _, q in pairs)], pa.int64()),
        }
    )


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = rows.filter(usable("vector"))
    classes = good.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    every = decoded(classes, largest)
    key = ["label", "dim", "direction"]
    crowds = every.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    crowds = crowds.select(*key, F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    meet = stored(every.join(crowds, key).select("cid", "dim", "direction", "blocks"), "vector-directions")
    # What a task needs of a class: its vector and the directions it shares with others.
    lists = meet.groupBy("cid").agg(F.array_sort(F.collect_list("direction")).alias("directions"))
    lists = classes.select("cid", "label", "copies", "vector").join(lists, "cid")
    tasks = meet.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select(
        F.col("cid").alias("c"), "dim", "direction", "blocks", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    found = lists.join(tasks, F.col("cid") == F.col("c")).drop("c")
    # Directions of several blocks have tasks of their own; the others, most of them tiny, share tasks.
    shards = F.lit(1 + meet.count() // ROWS_PER_TASK)
    found = found.withColumn("task", F.when(F.col("blocks") > 1, F.col("direction")).otherwise(F.pmod(F.xxhash64("direction"), shards)))
    found = stored(found.groupBy("label", "dim", "blocks", "task", "i", "j").applyInArrow(compare, "cid long, links long, other long"), "vector-links")

    n = found.filter("other IS NULL").groupBy(F.col("cid").alias("c")).agg(F.sum("links").alias("links"))
    roots = graph.components(found.filter("other IS NOT NULL").select(F.col("cid").alias("u"), F.col("other").alias("v")))
    known = classes.join(n, F.col("cid") == F.col("c"), "left").drop("c").join(roots, F.col("cid") == F.col("node"), "left")
    known = stored(known.select("label", "vector", "copies", "least", "links", F.coalesce("root", "cid").alias("root")), "vector-roots")
    least = known.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    per_class = known.join(least, F.col("root") == F.col("r")).select(
        F.col("label").alias("l"), F.col("vector").alias("v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component"
    )
    back = rows.filter(usable("vector")).join(per_class, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")))
    lone = rows.filter(~usable("vector")).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    every = back.select("vec_id", "n", "component").unionByName(lone)
    return every.select(
        "vec_id",
        F.col("n").alias("n_links"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
