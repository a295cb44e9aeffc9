"""Runs of repeated word sequences, by the branching-tandem test on enhanced suffix arrays.

A run is a stretch of words that keeps its smallest period q (words q apart are identical), is at least ``MIN_LENGTH``
and ``MIN_EXPONENT`` periods long and can't be extended. Where a run ends its last 2q words are a branching square: the
suffixes at its two halves share q words and go on differently. So in the LCP interval of depth q they lie in different
children, and one of them is not in the largest child: it is enough that the suffixes i of the smaller children ask
whether ISA[i + q] or ISA[i - q] lies in the interval. No tree nodes are made; an interval is four numbers of the stack
that reads the LCP array. Squares found are rotated to the left as far as their period holds, which gives the run, and
those of one stretch are merged: its smallest period stays.

Suffixes of many documents are sorted together by doubling, each document with an alphabet of its own, so that they never
compare across documents; only suffixes that are not alone yet take part in a round. A run has two suffixes q apart
that share at least max(MIN_LENGTH - q, (MIN_EXPONENT - 1) q) words, 16 by the values below. A document where all
suffixes are alone after their first 16 words has no run, and its sorting ends there; the others are sorted to the end
and take the test.

Work is a document's own: no shuffle. Defined cases: null and empty texts have no words and no runs; ids and texts of
repeated rows are treated row by row; very long texts are sorted alone, about 200 bytes of memory a word; an empty table
gives an empty result; columns other than the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import words_of

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words that are sorted together, about; a longer document is sorted alone.
WORDS_AT_ONCE = 200_000


def shared_least(min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> int:
    """Words that the suffixes at a run's start and one period later share, at least, whatever the period."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def sort_suffixes(symbols: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes and a flag per document: whether two of its suffixes share ``least`` words.

    ``symbols`` are words as numbers, each document with numbers of its own, in ascending blocks; ``doc`` is the document
    of each word. Ranks of documents without the flag are not settled beyond ``least`` words. A suffix that ends sorts
    first.
    """
    n = len(symbols)
    n_docs = int(doc[-1]) + 1 if n else 0
    # Documents' ends, for suffixes that reach beyond.
    last = np.zeros(n_docs, np.int64)
    last[doc] = np.arange(n)
    order = np.argsort(symbols, kind="stable")
    new = np.append(True, symbols[order[1:]] != symbols[order[:-1]])
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    width, flagged, looked = 1, np.ones(n_docs, bool), False
    active = _shared(rank, order)
    while len(active):
        if width >= least and not looked:
            flagged[:] = False
            flagged[doc[active]] = True
            active, looked = active[flagged[doc[active]]], True
        beyond = active + width
        inside = beyond <= last[doc[active]]
        second = np.where(inside, rank[np.minimum(beyond, n - 1)] + 1, 0)
        # Groups keep their places: a suffix's rank is where its group starts, plus those of the group before it.
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        first = rank[active]
        group = np.append(True, first[1:] != first[:-1])
        split = group | np.append(True, second[1:] != second[:-1])
        place = np.arange(len(active))
        group_start = np.maximum.accumulate(np.where(group, place, 0))
        split_start = np.maximum.accumulate(np.where(split, place, 0))
        rank[active] = first + split_start - group_start
        alone = split & np.append(split[1:], True)
        active = active[~alone]
        width *= 2
        if width > 2 * n:
            break
    if not looked:
        flagged[:] = False
    return rank, flagged


def _shared(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Suffixes whose rank another one has, in rank's order."""
    r = rank[order]
    same = r[1:] == r[:-1]
    return order[np.append(False, same) | np.append(same, False)]


def common_prefixes(text: Sequence[int], sa: Sequence[int], isa: Sequence[int]) -> array:
    """lcp[k]: words that the suffixes at places k - 1 and k share; lcp[0] is -1."""
    n, h = len(text), 0
    lcp = array("q", [-1]) * n
    for i in range(n):
        k = isa[i]
        if not k:
            h = 0
            continue
        j = sa[k - 1]
        top = n - max(i, j)
        while h < top and text[i + h] == text[j + h]:
            h += 1
        lcp[k] = h
        if h:
            h -= 1
    return lcp


def smaller_children(lcp: Sequence[int], deepest: int) -> np.ndarray:
    """Depth, interval lo, hi, child lo, hi, largest child lo, hi: rows for all but the largest child of each LCP interval.

    Bounds are places in the suffix array, the upper ones exclusive; intervals deeper than ``deepest`` are left out. A
    place outside all deeper intervals is a child of its own.
    """
    out = array("q")
    # An open interval: depth, where it starts, and where its children so far start.
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [0])]
    for k in range(1, len(lcp) + 1):
        h = lcp[k] if k < len(lcp) else -1
        start = k - 1
        while stack and stack[-1][0] > h:
            depth, start, children = stack.pop()
            if 0 < depth <= deepest:
                children.append(k)
                big = max(range(len(children) - 1), key=lambda c: children[c + 1] - children[c])
                lo, hi = children[big], children[big + 1]
                for c in range(len(children) - 1):
                    if c != big:
                        out.extend((depth, start, k, children[c], children[c + 1], lo, hi))
        if not stack:
            break
        if stack[-1][0] < h:
            stack.append((h, start, [start]))
        elif stack[-1][0] == h and stack[-1][2][-1] != start:
            stack[-1][2].append(start)
        stack[-1][2].append(k)
    return np.array(out, np.int64).reshape(-1, 7)


def branching_squares(symbols: np.ndarray, sa: np.ndarray, isa: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching squares with periods up to ``deepest``."""
    tests = smaller_children(common_prefixes(memoryview(symbols), memoryview(sa), memoryview(isa)), deepest)
    none = np.empty(0, np.int64)
    starts, periods = [none], [none]
    n = len(symbols)
    # Tests are expanded to suffixes in groups of bounded size; the smaller children hold n log n suffixes in all.
    sizes = np.cumsum(tests[:, 4] - tests[:, 3])
    cuts = np.searchsorted(sizes, np.arange(0, int(sizes[-1]) if len(sizes) else 0, 1_000_000))
    for a, b in zip(cuts, [*cuts[1:], len(tests)], strict=True):
        depth, lo, hi, c_lo, c_hi, big_lo, big_hi = np.repeat(tests[a:b], tests[a:b, 4] - tests[a:b, 3], axis=0).T
        if not len(depth):
            continue
        new = np.append(True, (c_lo[1:] != c_lo[:-1]) | (depth[1:] != depth[:-1]))
        place = np.arange(len(depth))
        i = sa[c_lo + place - np.maximum.accumulate(np.where(new, place, 0))]
        ahead = i + depth
        at = isa[np.minimum(ahead, n - 1)]
        hit = (ahead < n) & (at >= lo) & (at < hi) & ~((at >= c_lo) & (at < c_hi))
        back = i - depth
        at = isa[np.maximum(back, 0)]
        from_big = (back >= 0) & (at >= big_lo) & (at < big_hi)
        starts += [i[hit], back[from_big]]
        periods += [depth[hit], depth[from_big]]
    return np.concatenate(starts), np.concatenate(periods)


def rotated(symbols: np.ndarray, start: int, period: int) -> int:
    """Where the period of the square at ``start`` begins to hold; looks back in steps of growing size."""
    step = 64
    while start:
        a = max(0, start - step)
        differ = np.flatnonzero(symbols[a:start] != symbols[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, 2 * step
    return 0


def runs_of(
    symbols: np.ndarray, sa: np.ndarray, isa: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    start, period = branching_squares(symbols, sa, isa, len(symbols) // min_exponent)
    # A run reaches back from its square by what it is longer than two periods; most squares fail within a few words.
    missing = np.maximum(min_length, min_exponent * period) - 2 * period
    keep = start >= missing
    start, period, missing = start[keep], period[keep], missing[keep]
    for back in range(1, 9):
        before = np.maximum(start - back, 0)
        keep = (missing < back) | (symbols[before] == symbols[before + period])
        start, period, missing = start[keep], period[keep], missing[keep]
    found: dict[tuple[int, int], int] = {}
    for s, q, m in zip(start.tolist(), period.tolist(), missing.tolist(), strict=True):
        a = rotated(symbols, s, q)
        if s - a >= m:
            at = (a, s + 2 * q)
            found[at] = min(q, found.get(at, q))
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(min_length, min_exponent * q))


def runs_in(texts: list[list[bytes]], **limits) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several lists of words, sorted together."""
    numbers: list[np.ndarray] = []
    used = 0
    for words in texts:
        alphabet: dict[bytes, int] = {}
        own = np.fromiter((alphabet.setdefault(w, len(alphabet)) for w in words), np.int64, len(words))
        numbers.append(own + used)
        used += len(alphabet)
    sizes = np.array([len(x) for x in numbers], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    symbols = np.concatenate(numbers)
    rank, flagged = sort_suffixes(symbols, np.repeat(np.arange(len(filled)), sizes[filled]), shared_least(**limits))
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(flagged):
        t = filled[k]
        a, b = int(ends[t] - sizes[t]), int(ends[t])
        sa = np.argsort(rank[a:b])
        isa = np.empty(b - a, np.int64)
        isa[sa] = np.arange(b - a)
        out[t] = runs_of(symbols[a:b], sa, isa, **limits)
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


#: What ``collapse`` adds to each document.
RESULT = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def _digest(runs: list[tuple[int, int, int]], words: list[bytes], text: bool) -> tuple:
    """A row of ``RESULT``, and the collapsed text or nothing."""
    stay = kept_words(len(words), runs)
    kept = b" ".join(words if stay.all() else [w for w, s in zip(words, stay.tolist(), strict=True) if s])
    top = None
    for run in runs:  # by start, then period: the first of equal exponents stays
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    digests = hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()
    return (len(runs), *best, *digests, kept.decode("utf-8", "surrogatepass") if text else None)


def collapse(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_runs: bool = False,
    change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Per document: its id, number of runs, the run of greatest exponent, digests of all runs and of the kept words.

    ``with_runs`` adds ``runs`` (start, length, period) and ``collapsed``, the kept words joined by a space. ``change``
    may alter a document's words, given its id, before they are searched.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    kinds = [(c, pa.int64()) for c in longs] + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256", "collapsed")]
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def rows_out(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_in(texts)
        columns = list(zip(*(_digest(r, w, with_runs) for r, w in zip(found, texts, strict=True)), strict=True))
        arrays = [ids, *(pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True))]
        names = ["doc_id", *(c for c, _ in kinds)]
        if not with_runs:
            return pa.RecordBatch.from_arrays(arrays[:-1], names[:-1])
        listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], run_type)
        return pa.RecordBatch.from_arrays([*arrays, listed], [*names, "runs"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, begin = [], 0, 0
            for row in range(batch.num_rows):
                words = words_of(batch.column(1)[row].as_py() or "")
                if change:
                    words = change(batch.column(0)[row].as_py(), words)
                if texts and size + len(words) > WORDS_AT_ONCE:
                    yield rows_out(batch.column(0).slice(begin, len(texts)), texts)
                    texts, size, begin = [], 0, row
                texts.append(words)
                size += len(words)
            if texts:
                yield rows_out(batch.column(0).slice(begin, len(texts)), texts)

    kind = rows.schema["doc_id"].dataType.simpleString()
    more = ", collapsed string, runs array<struct<start: bigint, length: bigint, period: bigint>>" if with_runs else ""
    return rows.mapInArrow(search, f"doc_id {kind}, {RESULT}{more}")


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """One document in ten repeats a stretch from some word on to its end, chosen by its id (null ids: none)."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    # Word a + i becomes word a + i % p of the original.
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]
