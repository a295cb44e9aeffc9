"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens.

A sequence holds at most ``capacity`` tokens, ``max_segments`` pieces and ``max_loss`` tokens that bear loss; an example's
first ``prompt`` tokens bear none. Examples may be cut anywhere, and a sequence is padded to ``capacity`` unless its
length is a power of two.

The plan is made in the driver over counts, not examples: an example is full blocks of ``capacity`` tokens and a rest,
and what counts about each is its class (length, tokens of it without loss), at most ``capacity``^2 / 2 classes whatever
the corpus. Sequences are filled one pattern at a time, as often as the counts allow. A pattern takes the class with the
greatest dot product of its three sizes and the room left, each dimension weighted by its total demand, until none fits
whole. The gap is filled by cutting the longest piece, whose other part returns to the pool; where segments run out,
by cutting a full block. Other full blocks take no part and have sequences of their own. Where a limit other than tokens,
or the end of the pool, leaves a sequence short, it is closed at a power of two and the rest returns to the pool: nothing
is padded.

The plan is a table of slots: of the items of a class, ranks ``lo <= rank < hi`` give tokens ``from`` to ``from +
length`` to sequences ``sequence + rank - lo``. It is broadcast: each pattern uses up a class, and has a row for each of
its at most ``max_segments`` pieces and each part of the pool they come from; some thousand rows in practice. Ranks
are counted in buckets of a digest, so a class that a third of all items share is nobody's single task. Few items are
cut (one in some hundred): only those meet their stored ids again, all others keep the checksum taken with their tokens.

Tokens: byte-level BPE files whose ids follow the order of merges, as the public ones do, are read into the rank-based
library, which gives the same ids four times as fast (compared for every code point and mixed white space); other files
go through their own library.

Defined cases: null and empty texts are the end id alone; very long texts are cut like others, one text in memory at a
time; repeated rows are packed once per row; ids may be null; null or negative prompts are 0, longer ones the whole
example; an empty table gives an empty result; columns other than those named are not read, so clashing names do no harm.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.functions.ranking import bucketed_row_number, md5_bucket
from daygrid.llm.common import FILTER_BITS, bitset, contains, stored
from daygrid.llm.packing import tokenizer_path

CAPACITY = 1024
MAX_SEGMENTS = 64
MAX_LOSS = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: The pattern of byte-level pre-tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How byte-level vocabularies write bytes: printable Latin-1 as it is, the others as letters from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {
    chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _PRINTED)
}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by bytes, where the file is plain byte-level BPE and its ids follow the order of its merges."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )
    if not plain:
        return None
    added = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    singles = [i for t, i in vocab.items() if len(t) == 1]
    if not made or made != sorted(set(made)) or len(singles) < 256 or max(singles) > made[0] or len(vocab) != len(singles) + len(made):
        return None
    return {bytes(_BYTE_OF[c] for c in t): i for t, i in vocab.items()}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to uint32 ids, without special tokens added; kept by a worker for its next tasks."""
    import os

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = _ranks(spec)
    if ranks is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    encoding = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    named = set(special)

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in named):
            return np.array(encoding.encode(text, allowed_special=named, disallowed_special=()), "<u4")
        return np.array(encoding.encode_ordinary(text), "<u4")

    return ids


def items(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
) -> DataFrame:
    """Full blocks and rest of every example, with the end id: doc_id, doc_tokens, item (its first token), length, head
    (tokens without loss), ids_crc32, ids (little-endian uint32)."""
    path = path or tokenizer_path(TOKENIZER)
    prompt = F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)) if prompt_col else F.lit(0)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), prompt.cast("long").alias("prompt")
    )
    longs = ("doc_tokens", "item", "length", "head", "ids_crc32")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                source, out = [], []
                for row, (text, prompt) in enumerate(zip(part.column(1), part.column(2).to_pylist(), strict=True)):
                    ids = ids_of(text.as_py() or "").tobytes() + end
                    for b in range(0, len(ids), width):
                        own = ids[b : b + width]
                        first, length = b // 4, len(own) // 4
                        source.append(row)
                        out.append((len(ids) // 4, first, length, max(0, min(prompt - first, length)), zlib.crc32(own), own))
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
                owner = part.column(0).take(pa.array(source, pa.int64()))
                yield pa.RecordBatch.from_arrays([owner, *arrays, pa.array(columns[5], pa.binary())], ["doc_id", *longs, "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, {', '.join(f'{c} long' for c in longs)}, ids binary")


#: A slot: of the items of class (length, head), ranks lo <= rank < hi give ``size`` tokens from ``start`` to sequences
#: ``sequence + rank - lo``, at offset ``at``.
SLOT = "length long, head long, lo long, hi long, start long, size long, sequence long, at long"


class _Pool:
    """What is to be placed: for each class (length, head) a count and lots of equal parts of items."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        keys = sorted((k for k, n in counts.items() if n), key=lambda k: (-k[0], k[1]))
        self.at = {k: i for i, k in enumerate(keys)}
        self.keys = np.array(keys, np.int64).reshape(-1, 2)
        self.count = np.array([counts[k] for k in keys], np.int64)
        self.lots = [[(*k, 0, counts[k], 0)] for k in keys]

    def add(self, key: tuple[int, int], lot: tuple) -> None:
        """``lot``: class of the items (two numbers), lo, hi, where the part starts in its item."""
        if key not in self.at:
            self.at[key] = len(self.lots)
            self.keys = np.vstack([self.keys, key])
            self.count = np.append(self.count, 0)
            self.lots.append([])
        i = self.at[key]
        self.lots[i].append(lot)
        self.count[i] += lot[3] - lot[2]

    def take(self, i: int, n: int) -> list[tuple]:
        """Lots of ``n`` parts of the ``i``-th class."""
        self.count[i] -= n
        out, lots = [], self.lots[i]
        while n:
            *origin, lo, hi, start = lots.pop()
            used = min(n, hi - lo)
            if used < hi - lo:
                lots.append((*origin, lo + used, hi, start))
            out.append((*origin, lo, lo + used, start))
            n -= used
        return out


def plan(
    counts: dict[tuple[int, int], int],
    capacity: int = CAPACITY,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
) -> list[tuple[int, ...]]:
    """Slots (see ``SLOT``) of all items, given how many there are of each class (length, head)."""
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("a sequence has room for a token, a segment and a token that bears loss at least")
    limits = np.array([capacity, max_segments, max_loss], float)
    demand = sum((n * np.array([length, 1, length - head], float) for (length, head), n in counts.items()), np.zeros(3)) / limits
    weight = demand / max(demand.sum(), 1e-300) / limits**2
    pool, slots, sequence = _Pool(counts), [], 0
    while pool.count.any():
        alive = np.flatnonzero(pool.count)
        length, head = pool.keys[alive].T
        left = pool.count[alive]
        sizes = np.column_stack([length, np.ones(len(alive)), length - head])
        room, pattern = limits.copy(), []  # pattern: (class, tokens of it that are placed)
        while room[1] >= 1:
            fits = (left > 0) & (length < capacity) & (sizes <= room).all(axis=1)
            if room[1] < 2:  # the last segment is a cut one's, unless a whole piece fills the room
                fits &= length == room[0]
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, sizes @ (weight * room), -1.0)))
            left[best] -= 1
            pattern.append((int(alive[best]), int(length[best])))
            room -= sizes[best]
        if room[0] and room[1]:
            # None fits whole: part of a shorter piece, the longest of those that give most, or of a full block where
            # segments run out. Tokens without loss come first in each.
            gives = np.where(left > 0, np.minimum(np.minimum(length, room[0]), head + room[2]), 0).astype(int)
            if not (room[1] < 2 and gives[length < capacity].max(initial=0) < room[0]):
                gives[length == capacity] = 0
            best = int(np.argmax(gives * (capacity + 1) + length)) if gives.any() else 0
            if gives.any():
                pattern.append((int(alive[best]), int(gives[best])))
                room[0] -= gives[best]
            elif not pattern:  # full blocks only
                best = int(np.argmax(left))
                pattern.append((int(alive[best]), min(capacity, int(head[best]) + max_loss)))
                room[0] -= pattern[0][1]
        total = capacity - int(room[0])
        closed = total if total == capacity else 1 << total.bit_length() - 1
        kept, at = [], 0
        for i, size in pattern:
            if at < closed:
                kept.append((i, min(size, closed - at), at))
                at += size
        uses = Counter(i for i, _, _ in kept)
        times = int(min(pool.count[i] // n for i, n in uses.items()))
        for i, size, at in kept:
            first, (length_i, head_i) = sequence, pool.keys[i].tolist()
            for *origin, lo, hi, start in pool.take(i, times):
                slots.append((*origin, lo, hi, start, size, first, at))
                first += hi - lo
                if size < length_i:
                    pool.add((length_i - size, max(0, head_i - size)), (*origin, lo, hi, start + size))
        sequence += times
    return slots


def classes(cut: DataFrame) -> dict[tuple[int, int], int]:
    """Items of each class; at most ``capacity``^2 / 2 rows reach the driver."""
    counted: Iterable = cut.groupBy("length", "head").agg(F.count("*").alias("n")).toLocalIterator()
    return {(r["length"], r["head"]): r["n"] for r in counted}


def _ids_of(cut: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids of the items of ``cut``; a bitset of bounded size keeps most of the others from the join."""
    place = F.pmod(F.xxhash64("item_no"), F.lit(FILTER_BITS)).alias("place")
    bits = bitset(cut.select(place))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(contains(bits, batch.column(0).to_numpy()))).select([1, 2])

    return rows.select(place, F.col("item_no").alias("of_item"), "ids").mapInArrow(possible, "of_item long, ids binary")


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    end_id: int = END_ID,
    with_ids: bool = False,
    **columns,
) -> DataFrame:
    """All pieces of ``docs`` with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``with_ids`` adds the ids of each piece. ``columns``: id_col, text_col, prompt_col.
    """
    rows = items(docs, path, capacity, end_id, **columns).withColumn("item_no", F.monotonically_increasing_id())
    rows = stored(rows, "items", compression="zstd")
    slots = rows.sparkSession.createDataFrame(plan(classes(rows), capacity, max_segments, max_loss), SLOT)
    slots = slots.select(*[F.col(c).alias(f"s_{c}") for c in slots.columns])
    bucket = md5_bucket(F.col("item_no").cast("string"))
    ranked = bucketed_row_number(rows.drop("ids"), ["length", "head"], bucket, [F.col("item_no")])
    nth = F.col("rank") - 1
    fits = (F.col("length") == F.col("s_length")) & (F.col("head") == F.col("s_head")) & (nth >= F.col("s_lo")) & (nth < F.col("s_hi"))
    silent = F.greatest(F.lit(0), F.least(F.col("head") - F.col("s_start"), F.col("s_size")))
    placed = ranked.join(F.broadcast(slots), fits).select(
        "doc_id",
        (F.col("item") + F.col("s_start")).alias("start"),
        F.col("s_size").alias("length"),
        F.when(F.col("s_size") == F.col("length"), F.col("ids_crc32")).alias("ids_crc32"),
        "doc_tokens",
        (F.col("s_sequence") + nth - F.col("s_lo")).alias("sequence_id"),
        F.col("s_at").alias("offset"),
        (F.col("s_size") - silent).alias("loss_tokens"),
        "item_no",
        F.col("s_start").alias("inside"),
    )
    placed = stored(placed, "placed")
    cut = placed if with_ids else placed.filter("ids_crc32 IS NULL")
    ids = rows.select(F.col("item_no").alias("of_item"), "ids") if with_ids else _ids_of(cut, rows)
    own = F.expr("substring(ids, cast(4 * inside + 1 AS int), cast(4 * length AS int))")
    cut = cut.join(ids, F.col("item_no") == F.col("of_item")).withColumn("ids", own).withColumn("ids_crc32", F.crc32("ids"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    if with_ids:
        return cut.select(*names, "ids")
    return placed.filter("ids_crc32 IS NOT NULL").select(names).unionByName(cut.select(names))
