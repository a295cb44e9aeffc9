"""Repeated long byte strings, found through a logarithmic family of suffix arrays.

Sampled suffixes stand for all: in every string of ``MATCH`` bytes one suffix start is chosen by the string's content
alone (the start of its smallest ``PREFIX``-byte piece), so equal strings choose the same one, and the ``PREFIX`` bytes
that follow it are common to both. A suffix is its first ``PREFIX`` bytes; arrays hold suffixes in the order of these.

``IndexFamily`` takes batches. The suffixes of a batch are merged with the arrays there are into one byte order, dealt
by ranges, and scanned: each learns the bytes it shares with its neighbours, which are the longest it shares with any.
Where that is ``PREFIX`` bytes, a long match may begin. The scan leaves the batch's own array with these lengths. Arrays
of equal size merge into one of twice the size before the next scan, so n batches are rewritten log n times. Suffixes
that agree are one row with a count, combined before any range is formed, so no range holds copies.

Matched suffixes are settled exactly, by counting fingerprints, so a passage that a third of all documents share is no
group in any task. A chosen start stands for a run of strings (those that chose it). First the bytes of the whole run
are counted: if they occur twice, the whole run is repeated. Else the run is cut into parts; of a part, the bytes common
to all its strings must occur twice, or none of its strings does. Parts left over are cut again, down to single strings.

Equal texts are one class with a number of copies; a class with two copies is removed whole.

Defined cases: a null text is empty; texts shorter than ``MATCH`` keep all bytes; matches never cross texts; overlapping
occurrences in one text count; ids may be null or repeated, every row gets a row, repeated rows are copies; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import FILTER_BITS, bitset, contains, mixed, stored

MATCH = 400
PREFIX = 64
#: Batches in which a whole table enters the index.
BATCHES = 4
#: Widths of the parts into which runs of strings are cut, round by round.
PARTS = (36, 6, 1)
#: Documents handled at once in a task.
TEXTS_AT_ONCE = 500
#: Bytes of texts handled at once, where there is more than one text.
BYTES_AT_ONCE = 16 << 20
_BASE = 0xD6E8FEB86659FD93


class Fingerprints:
    """64-bit fingerprints of byte ranges: differences of running sums of byte values times powers of a base."""

    def __init__(self):
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, data: bytes) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[np.frombuffer(data, np.uint8)] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.inverse[start])


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, 1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def chosen(prints: Fingerprints, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix starts that strings of ``MATCH`` bytes choose: start, its prefix's fingerprint, first and last string.

    Pieces are compared by the high half of their fingerprints, then by place: equal strings choose alike.
    """
    n = len(sums) - 1
    if n < MATCH:
        empty = np.empty(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    at = np.arange(n - PREFIX + 1)
    pieces = prints.of(sums, at, at + PREFIX)
    ranked = (pieces & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    least = (_sliding_minimum(ranked, MATCH - PREFIX + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    start = least[first]
    return start, pieces[start], first, last


def _class(data: bytes) -> tuple[int, str]:
    digest = hashlib.sha256(data)
    return int.from_bytes(digest.digest()[:8], "little", signed=True), digest.hexdigest()


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _portions(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in portions, each with the place of its first row."""
    at, size, portion = 0, 0, []
    for n in range(0, len(column), TEXTS_AT_ONCE):
        for data in _texts(column.slice(n, TEXTS_AT_ONCE)):
            if portion and (len(portion) == TEXTS_AT_ONCE or size + len(data) > BYTES_AT_ONCE):
                yield at, portion
                at, size, portion = at + len(portion), 0, []
            portion.append(data)
            size += len(data)
    if portion:
        yield at, portion


def _binaries(pieces: list[np.ndarray], width: int) -> pa.Array:
    """Rows of ``width`` bytes as one binary array."""
    flat = np.concatenate([np.empty(0, np.uint8), *[p.ravel() for p in pieces]])
    offsets = np.arange(0, len(flat) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _listed(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, class, sha256, chosen suffixes (start, first bytes, their fingerprint).

    A task lists the suffixes of a class once; copies that several tasks list only cost work later.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, seen = Fingerprints(), set()
        nothing = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            for at, portion in _portions(batch.column(1)):
                sizes, names, digests, starts, keys, heads = [], [], [], [], [], []
                for data in portion:
                    name, digest = _class(data)
                    sizes.append(len(data))
                    names.append(name)
                    digests.append(digest)
                    start, key = nothing
                    if name not in seen and len(data) >= MATCH:
                        seen.add(name)
                        start, key, _, _ = chosen(prints, prints.sums(data))
                        heads.append(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), PREFIX)[start])
                    starts.append(start)
                    keys.append(key)
                counts = [len(x) for x in starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(portion)),
                        pa.array(sizes, pa.int64()),
                        pa.array(names, pa.int64()),
                        pa.array(digests, pa.string()),
                        _listed(pa.array(np.concatenate(starts).astype(np.int32)), counts),
                        _listed(pa.array(np.concatenate(keys).view(np.int64)), counts),
                        _listed(_binaries(heads, PREFIX), counts),
                    ],
                    ["doc_id", "n_bytes", "class", "sha256", "starts", "keys", "heads"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, class long, sha256 string, starts array<int>, keys array<bigint>, heads array<binary>"
    )


def common_lengths(heads: pa.Array) -> np.ndarray:
    """Bytes that each of the sorted suffixes, ``PREFIX`` bytes each, has in common with the next."""
    offsets = np.frombuffer(heads.buffers()[1], np.int32)[heads.offset : heads.offset + len(heads) + 1]
    rows = np.frombuffer(heads.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, PREFIX)
    other = rows[1:] != rows[:-1]
    return np.where(other.any(1), other.argmax(1), PREFIX)


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From suffixes in order (head, key, n, fresh): the fresh ones in order, with ``longest``, the bytes shared with another."""
    held, left = None, 0
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not rows.num_rows:
            continue
        after = common_lengths(rows.column("head").chunk(0))
        before = np.concatenate([[left], after])
        last = rows.num_rows - 1
        yield from _fresh(rows.slice(0, last), np.maximum(before[:-1], after))
        held, left = rows.slice(last).to_batches()[0], before[-1]
    if held is not None:
        yield from _fresh(pa.Table.from_batches([held]), np.array([left]))


def _fresh(rows: pa.Table, longest: np.ndarray) -> Iterator[pa.RecordBatch]:
    longest = np.where(np.array(rows.column("n")) > 1, PREFIX, longest).astype(np.int32)
    out = rows.select(["head", "key", "n"]).append_column("longest", pa.array(longest))
    yield from out.filter(rows.column("fresh")).to_batches()


class IndexFamily:
    """Sorted arrays of suffixes (head, key, n, longest); ``insert`` returns keys of a batch's suffixes that occur twice by now.

    An array's partitions are ranges of heads in rising order, each sorted.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def _merge(self) -> None:
        """Merge the last two levels while they are of equal size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            ranges = a.unionByName(b).repartitionByRange("head")
            both = ranges.groupBy("head").agg(F.min("key").alias("key"), F.sum("n").alias("n"), F.max("longest").alias("longest"))
            self.levels.append((2 * size, stored(both.sortWithinPartitions("head"), f"suffix-level-{2 * size}")))

    def insert(self, batch: DataFrame) -> DataFrame:
        """``batch``: columns ``head``, ``key``. Scans the batch merged with every level, then adds it."""
        self._merge()
        rows = batch.groupBy("head").agg(F.min("key").alias("key"), F.count("*").alias("n")).withColumn("fresh", F.lit(True))
        for _, level in self.levels:
            rows = rows.unionByName(level.select("head", "key", "n", F.lit(False).alias("fresh")))
        ordered = rows.repartitionByRange("head").sortWithinPartitions("head")
        level = stored(ordered.mapInArrow(scanned, "head binary, key long, n long, longest int"), "suffix-level-1")
        self.levels.append((1, level))
        return level.filter(F.col("longest") >= PREFIX).select("key")


def _parts(start: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Cut runs into parts aligned to the chosen start: first and last string, aligned bounds of the part's offsets.

    A string's offset is the chosen start minus its own; equal strings have equal offsets, hence equal parts.
    """
    low, high = start - last, start - first
    n = high // width - low // width + 1
    run = np.repeat(np.arange(len(start)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    part = low[run] // width + step
    a, b = np.maximum(part * width, low[run]), np.minimum(part * width + width - 1, high[run])
    return start[run] - b, start[run] - a, part * width, np.minimum(part * width + width - 1, MATCH - PREFIX)


def _salted(prints: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    for x in more:
        prints = mixed(prints ^ (np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return prints


def _whole(prints: Fingerprints, sums: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprint of all bytes of the strings ``first`` to ``last`` that chose ``start``."""
    return _salted(prints.of(sums, first, last + MATCH), start - first, start - last, 1)


def _common(prints: Fingerprints, sums: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Fingerprint of the bytes that all strings at offsets ``low`` to ``high`` before ``start`` have in common."""
    return _salted(prints.of(sums, start - low, start - high + MATCH), low, high, 2)


def _settled(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settle the parts of one round: runs of strings that are repeated, and what the next round has to look at.

    Parts with the same bytes are repeated. Of each content one part goes on, and only where its common bytes also
    occur in another content of which some part is still open; ``open`` tells whether the part itself is, or only shows
    others that their strings occur elsewhere.
    """
    place = ["class", "start", "parent", "first", "last"]
    contents = parts.groupBy("whole").agg(
        F.count("*").alias("n"), F.min(F.struct(*place)).alias("place"), F.min("common").alias("common"), F.max("open").alias("open")
    )
    contents = stored(contents.withColumn("open", F.col("open") & (F.col("n") == 1)), "suffix-contents")
    twice = contents.filter("n > 1").select(F.col("whole").alias("w"))
    done = parts.filter("open").join(twice, F.col("whole") == F.col("w")).select("class", "first", "last")
    shared = contents.groupBy("common").agg(F.count("*").alias("m"), F.max("open").alias("any")).filter("m > 1 AND any")
    going = contents.join(shared.select(F.col("common").alias("c")), F.col("common") == F.col("c"), "left_semi")
    return stored(done, "suffix-repeated"), going.select("place.*", "open")


def matched_texts(docs: DataFrame, flagged: DataFrame, text_col: str = "text") -> DataFrame:
    """(class, data, starts): one text for each class with matched suffixes."""
    maybe = bitset(flagged.select(F.expr(f"class & {FILTER_BITS - 1}").alias("place")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, portion in _portions(batch.column(0)):
                out = {_class(x)[0]: x for x in portion if len(x) >= MATCH}
                places = np.array([c & (FILTER_BITS - 1) for c in out], np.int64)
                ok = contains(maybe, places)
                if ok.any():
                    rows = [r for r, keep in zip(out.items(), ok, strict=True) if keep]
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], ["class", "data"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "class long, data binary")
    one = texts.groupBy("class").agg(F.first("data").alias("data"))
    return one.join(flagged.withColumnRenamed("class", "c"), F.col("class") == F.col("c")).drop("c")


def repeated_strings(texts: DataFrame) -> DataFrame:
    """(class, first, last): runs of strings of ``MATCH`` bytes that occur twice, from ``matched_texts``."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            names, rows = [], []
            for name, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                sums = prints.sums(data.as_py())
                start, key, first, last = chosen(prints, sums)
                ok = np.isin(start, wanted)
                start, key, first, last = start[ok], key[ok], first[ok], last[ok]
                names.append(np.full(len(start), name, np.int64))
                print_of = _whole(prints, sums, start, first, last)
                rows.append(np.stack([start, first, last, print_of.view(np.int64), key.view(np.int64)]))
            if rows:
                columns = np.concatenate(rows, 1)
                arrays = [np.concatenate(names), *[c.astype(np.int32) for c in columns[:3]], columns[3], columns[4]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["class", "start", "first", "last", "whole", "common"])

    runs = texts.mapInArrow(whole, "class long, start int, first int, last int, whole long, common long")
    runs = stored(runs.withColumns({"parent": F.lit(0), "open": F.lit(True)}), "suffix-runs")
    done, going = _settled(runs)
    found = done
    source, same = texts.withColumns({"origin": F.lit(0), "start": F.lit(0)}), F.col("class") == F.col("c")
    for width in PARTS:
        run = F.struct("start", "first", "last", "open")
        wanted = going.groupBy(F.col("class").alias("c"), F.col("parent").alias("p")).agg(F.collect_list(run).alias("runs"))
        # From here on a run carries its own bytes, at most 2 * MATCH of them.
        open_runs = stored(_sliced(source.join(wanted, same)), "suffix-open")
        parts = stored(_cut(open_runs, width), "suffix-parts")
        done, going = _settled(parts)
        found = found.unionByName(done)
        source, same = open_runs.withColumn("origin", F.col("first")), (F.col("class") == F.col("c")) & (F.col("first") == F.col("p"))
    return found


def _sliced(source: DataFrame) -> DataFrame:
    """Runs with their own bytes, cut from ``data`` that begins at byte ``origin`` of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, origin, data, runs in zip(*[batch.column(i) for i in range(4)], strict=True):
                name, origin, data = name.as_py(), origin.as_py(), data.as_py()
                for r in runs.as_py():
                    own = data[r["first"] - origin : r["last"] - origin + MATCH]
                    out.append((name, r["start"], r["first"], r["last"], r["open"], own))
                    if len(out) >= 20_000:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            ["class", "start", "first", "last", "open", "data"],
        )

    return source.select("class", "origin", "data", "runs").mapInArrow(
        run, "class long, start int, first int, last int, open boolean, data binary"
    )


def _cut(runs: DataFrame, width: int) -> DataFrame:
    """Parts of runs (``parent``: the run's first string), fingerprints of all their bytes and of the common ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            names, still, out = [], [], []
            for name, start, first, last, is_open, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sums = prints.sums(data)
                # Places relative to the run's own bytes.
                own = np.array([start - first]), np.array([0]), np.array([last - first])
                a, b, low, high = _parts(*own, width)
                at = np.full(len(a), start - first)
                names.extend([name] * len(a))
                still.extend([is_open] * len(a))
                all_bytes = _whole(prints, sums, at, a, b).view(np.int64)
                common = _common(prints, sums, at, low, high).view(np.int64)
                out.append(np.stack([at + first, a + first, b + first, np.full(len(a), first), all_bytes, common]))
            if out:
                c = np.concatenate(out, 1)
                arrays = [pa.array(names, pa.int64()), *[pa.array(x.astype(np.int32)) for x in c[:4]], pa.array(c[4]), pa.array(c[5]), pa.array(still)]
                yield pa.RecordBatch.from_arrays(arrays, ["class", "start", "first", "last", "parent", "whole", "common", "open"])

    return runs.mapInArrow(
        run, "class long, start int, first int, last int, parent int, whole long, common long, open boolean"
    )


def without_repeats(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``data`` without the bytes of strings ``first`` to ``last`` of each run; removed runs."""
    kept, spans, at = [], 0, 0
    end = -1
    for first, last in sorted(runs):
        if first > end:
            kept.append(data[max(end, 0) : first])
            spans += 1
        end = max(end, last + MATCH)
    kept.append(data[max(end, 0) :])
    return b"".join(kept), spans


def cleaned(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(class, kept, n_spans): the bytes left of each class with repeated strings."""
    runs = found.groupBy(F.col("class").alias("c")).agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data, own in zip(*[batch.column(i) for i in range(3)], strict=True):
                kept, spans = without_repeats(data.as_py(), [(r["first"], r["last"]) for r in own.as_py()])
                rows.append((name.as_py(), kept, spans))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())],
                    ["class", "kept", "n_spans"],
                )

    rows = texts.select("class", "data").join(runs, F.col("class") == F.col("c")).select("class", "data", "runs")
    return rows.mapInArrow(run, "class long, kept binary, n_spans long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; what is left, as ``kept``, where asked for.

    ``kept`` is null where nothing was removed.
    """
    rows = stored(suffixes(docs, id_col, text_col), "suffixes")
    index, matched = IndexFamily(), None
    for n in range(batches):
        batch = rows.filter(F.pmod(F.xxhash64("class"), F.lit(batches)) == n)
        batch = batch.select(F.explode(F.arrays_zip("heads", "keys")).alias("s")).select(F.col("s.heads").alias("head"), F.col("s.keys").alias("key"))
        found = index.insert(batch)
        matched = found if matched is None else matched.unionByName(found)
    matched = stored(matched.distinct().select(F.col("key").alias("k")), "suffix-matches")
    listed = rows.select("class", F.explode(F.arrays_zip("starts", "keys")).alias("s")).select("class", "s.starts", "s.keys")
    listed = listed.join(matched, F.col("keys") == F.col("k"), "left_semi")
    flagged = stored(listed.groupBy("class").agg(F.collect_set("starts").alias("starts")), "suffix-flagged")
    texts = stored(matched_texts(docs, flagged, text_col), "suffix-texts")
    left = cleaned(texts, repeated_strings(texts)).select(
        F.col("class").alias("c"),
        F.octet_length("kept").cast("long").alias("n_kept"),
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
        *([F.col("kept")] if with_kept else []),
    )
    left = stored(left, "suffix-cleaned")
    copies = rows.filter(F.col("n_bytes") >= MATCH).groupBy(F.col("class").alias("d")).agg(F.count("*").alias("copies")).filter("copies > 1")
    every = rows.select("doc_id", "n_bytes", "class", "sha256").join(left, F.col("class") == F.col("c"), "left")
    every = every.join(copies, F.col("class") == F.col("d"), "left")
    copied = F.col("copies").isNotNull()
    return every.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("n_kept"), F.lit(0))).alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *([F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_kept else []),
    )
