"""Best-fit packing planned on the histogram of lengths.

Texts become pieces of at most ``capacity`` tokens. The plan needs only how many pieces each length has: at most
``capacity`` counts, whatever the corpus size. Best-fit decreasing runs over those counts, whole runs of equal sequences
at a time, and leaves slots: pieces ``lo <= rank < hi`` of one length go ``per`` to a sequence, from a first sequence
and offset on. Pieces take their slots by joining on length and rank within length.

The rank is counted in buckets: pieces of a length spread over buckets by a hash, are numbered inside a bucket and
shifted by the counts of the buckets before, so a length that a third of all pieces share is nobody's single task. The
plan is broadcast: every step of the planner uses up a length or a run of sequences, runs are at most three per length,
and a sequence holds at most 90 different lengths at 4096 tokens; in practice it is a few thousand rows.

Tokens come from a public tokenizer; the end id closes every document. Texts in Latin letters are cut into the tokenizer's
pieces by its pattern, a mark after each, and the rank-based library merges the bytes of a piece and its mark: byte and
mark first, then by rank, as the file's merges do, whose ids follow their order (compared on every document of the test
tables and on 700,000 words of letters, accents and marks). For other texts the tokenizer separates at white space
before anything else, so ids of blank-separated chunks are remembered and texts are looked up chunk by chunk.

Defined cases: null and empty texts are one piece holding the end id; repeated rows are packed once per row; ids may be
null; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid.llm.common import stored

CAPACITY = 4096
END_ID = 1
#: Chunks, and words in them, that a task remembers, and the longest one worth remembering.
CHUNKS_KEPT = 200_000
CHUNK_CHARS = 48
_ASCII_PARTS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
_MARKS = ".,;:!?"
#: Letters up to here have one lower-case letter each (but U+0130) and no other composed form.
_LATIN = "\u024f"
#: How byte-level vocabularies write bytes: printable Latin-1 as it is, the others as letters from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip([b for b in range(256) if b not in _PLAIN], range(256, 512)))
#: Texts whose unknown chunks are encoded in one call.
TEXTS_AT_ONCE = 256
#: Pieces that one task numbers, about.
PIECES_PER_BUCKET = 100_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; another path may be given to every function here."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: What the marked way takes: characters with one lower-case form, no other composed form and a settled class.
_SETTLED = re.compile("[\t-\r\x20-\x84\x86-\u012f\u0131-\u024f\u2010-\u2023\u2025-\u2027]*")
#: The pattern of the word tokenizer (fixed value), and the same for settled characters.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
MARK = "\x01"


@functools.lru_cache(maxsize=2)
def marked_encoding(path: str):
    """Rank-based encoding of marked pieces, kept by a worker for its next tasks; nothing for other kinds of files."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [{}]
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    known = steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("invert") and normal == ["NFC", "Replace", "Lowercase"]
    if not known or model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout"):
        return None
    vocab, added = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if made != list(range(512, 512 + len(made))):
        return None
    byte_of = {chr(c): b for b, c in {**{b: b for b in _PLAIN}, **_BYTE_CHARS}.items()}
    ranks = {}
    for token, i in vocab.items():
        if token not in added:
            text = token.removesuffix("</w>")
            ranks[bytes(byte_of[c] for c in text) + (MARK.encode() if text != token else b"")] = i
    import tiktoken

    return tiktoken.Encoding("marked", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})


class ChunkIds:
    """Ids of texts as little-endian uint32 bytes, through remembered chunks and the words in them.

    The tokenizer lower-cases and separates letters, single digits and runs of other characters, so a chunk's ids are
    those of its lower-cased words and of what surrounds them. Only plain cases are taken apart: chunks in ASCII without
    apostrophes, and marks after a last letter; all else is encoded as it stands. Words of Latin letters in lower case go
    straight to the tokenizer's model, which knows capitals as other ids: long chunks keep theirs and take the whole way.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marked = marked_encoding(path)
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _parts(self, chunk: str) -> list[str]:
        if len(chunk) > CHUNK_CHARS or "<|" in chunk:
            return [chunk]
        if chunk.isascii():
            return [chunk] if "'" in chunk else _ASCII_PARTS.findall(chunk.lower())
        word = chunk.rstrip(_MARKS)
        if word[-1:].lower().isalpha():
            low = word.lower() if max(word) <= _LATIN and "\u0130" not in word else word
            return [low, chunk[len(word) :]] if len(word) < len(chunk) else [low]
        return [chunk]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.marked is not None and "<|" not in t and _SETTLED.fullmatch(t) is not None for t in texts]
        rest = [t for t, p in zip(texts, plain, strict=True) if not p]
        others = iter(self._by_chunks(rest) if rest else ())
        return [self._by_marks(t) if p else next(others) for t, p in zip(texts, plain, strict=True)]

    def _by_marks(self, text: str) -> bytes:
        parts = _PIECE.findall(text.lower())
        return array("I", self.marked.encode_ordinary(MARK.join([*parts, ""]))).tobytes()

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        for known in (self.chunks, self.words):
            if len(known) > CHUNKS_KEPT:
                known.clear()
        self.chunks[""] = b""
        new = {c: self._parts(c) for c in set().union(*split) - self.chunks.keys()}
        words = {w for parts in new.values() for w in parts} - self.words.keys()
        rest = []
        for w in words:
            if w.isalpha() and w == w.lower() and (w.isascii() or max(w) <= _LATIN):
                # Lower-case letters only: one piece for the model, its bytes written as the byte-level step writes them.
                piece = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS)
                self.words[w] = array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
            else:
                rest.append(w)
        for w, x in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self.words[w] = array("I", x.ids).tobytes()
        word = self.words.__getitem__
        self.chunks.update((c, word(p[0]) if len(p) == 1 else b"".join(map(word, p))) for c, p in new.items())
        out = [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in split]
        for c in [c for c in new if len(c) > CHUNK_CHARS]:
            del self.chunks[c], self.words[c]
        return out


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens that ``pieces`` cuts a text into, with the end id."""
    path = path or tokenizer_path()

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of = ChunkIds(path)
        for texts in batches:
            parts = (texts.slice(at, TEXTS_AT_ONCE) for at in range(0, len(texts), TEXTS_AT_ONCE))
            parts = ([x or "" for x in part.to_pylist()] for part in parts)
            yield pa.array([len(ids) // 4 + 1 for part in parts for ids in ids_of.encode(part)], pa.int64())

    return count(text)


def pieces(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32; the ids themselves where ``with_ids`` is set."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    extra = [pa.field("ids", pa.binary())] if with_ids else []
    kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kind_of_id = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ChunkIds(path)
        end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = [x or "" for x in part.column(1).to_pylist()]
                source, out = [], []
                for row, ids in enumerate(ids_of.encode(texts)):
                    ids += end
                    for n, b in enumerate(range(0, len(ids), width)):
                        piece = ids[b : b + width]
                        source.append(row)
                        out.append((n, b // 4, len(piece) // 4, zlib.crc32(piece), piece))
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                arrays = [part.column(0).take(pa.array(source, pa.int64()))]
                arrays += [pa.array(columns[i], t) for i, (_, t) in enumerate(kinds)]
                names = ["doc_id"] + [n for n, _ in kinds]
                if with_ids:
                    arrays.append(pa.array(columns[4], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind_of_id}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if extra else "")
    return rows.mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (length -> pieces): slots (length, lo, hi, per, sequence, offset).

    Pieces ``lo <= rank < hi`` of a length go ``per`` to a sequence, starting with ``sequence``, at ``offset`` and on.
    """
    room: list[int] = []  # free tokens, sorted; runs[free] are runs (first sequence, number) with so much left
    runs: dict[int, list[tuple[int, int]]] = {}
    slots, unused = [], 0

    def put(free: int, first: int, number: int) -> None:
        if not number or not free:
            return
        if free not in runs:
            insort(room, free)
            runs[free] = []
        runs[free].append((first, number))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(room, length)
            if at < len(room):
                free = room[at]
                first, number = runs[free].pop()
                if not runs[free]:
                    del runs[free]
                    room.pop(at)
            else:
                free, first, number = capacity, unused, -(-left // (capacity // length))
                unused += number
            per = free // length
            whole = min(number, left // per)
            if whole:
                slots.append((length, rank, rank + whole * per, per, first, capacity - free))
                put(free - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            first, number = first + whole, number - whole
            if number and 0 < left < per:
                slots.append((length, rank, rank + left, left, first, capacity - free))
                put(free - left * length, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            put(free, first, number)
    return slots


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Add ``rank`` from 0 within ``length``, counted in buckets of the unique column ``key``."""
    total = rows.count()
    n = max(1, total // PIECES_PER_BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy(key)) - 1
    rows = rows.withColumn("inside", inside)
    joined = rows.join(counts, (rows["length"] == counts["l"]) & (rows["bucket"] == counts["b"]))
    return joined.withColumn("rank", F.col("base") + F.col("inside")).drop("bucket", "l", "b", "base", "inside")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, **columns) -> DataFrame:
    """All pieces of ``docs`` with their ``sequence_id`` and ``offset``."""
    rows = stored(
        pieces(docs, path, capacity, with_ids=with_ids, **columns).withColumn("piece_no", F.monotonically_increasing_id()),
        "pieces",
    )
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = rows.sparkSession.createDataFrame(
        plan(histogram, capacity), "slot_length long, lo long, hi long, per long, sequence long, at long"
    )
    rows = ranked(rows, "piece_no")
    fits = (rows["length"] == slots["slot_length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    return (
        rows.join(F.broadcast(slots), fits)
        .withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("per")).cast("long"))
        .withColumn("offset", F.col("at") + F.pmod(nth, F.col("per")) * F.col("length"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")
    )
