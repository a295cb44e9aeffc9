"""Packing plans and tokens against direct ones; chat logs round trip."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daygrid.llm import chat, packing


def places(counts, capacity):
    """(sequence, offset, length) of every piece of a plan; ranks must be covered once."""
    out, ranks = [], defaultdict(list)
    for length, lo, hi, per, sequence, at in packing.plan(counts, capacity):
        for r in range(lo, hi):
            out.append((sequence + (r - lo) // per, at + (r - lo) % per * length, length))
            ranks[length].append(r)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    return out


@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(counts):
    used = defaultdict(list)
    for sequence, at, length in places(counts, 60):
        used[sequence].append((at, length))
    for own in used.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= 60
    bins = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = [b for b in bins if b[0] >= length]
        if fit:
            min(fit, key=lambda b: b[0])[0] -= length
        else:
            bins.append([60 - length])
    assert len(used) == len(bins)


def test_plan_does_not_grow_with_the_corpus():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 50) for n in range(1, 4097)}
    more = {n: c * 1_000_003 for n, c in counts.items()}
    assert len(packing.plan(more)) < 2 * len(packing.plan(counts)) < 60_000


TEXTS = [None, "", " ", "Hello  World\n\nit's <|endoftext|> x", "É́ ΑΣ\x1cq r s", "word " * 9000, "z" * 300, "same text here", "same text here"]


#: Runs of letters beyond CHUNK_CHARS with capitals, and marks, accents and case mappings at the edge of the short cuts.
LONG_RUNS = ["ACGT" * 20, "A" * 49, "CamelCase" * 8, "ÀÉÎõü" * 12, "Straße" * 10, "z" * 60 + "\u0130", "é" * 60, "ÀÉ" * 24, "ACGT" * 12]


def test_long_runs_match_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = [*LONG_RUNS, *[f"a {x} b" for x in LONG_RUNS], *[x + "." for x in LONG_RUNS]]
    for text, ids in zip(texts, packing.ChunkIds(packing.tokenizer_path()).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "x")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(0) for c in ("length", "rank", "offset", "ids", "piece")})
    rows = packing.pack(docs, with_ids=True).collect()
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    for i, text in [*enumerate(TEXTS), (None, "x")]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        cut = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        got = sorted(own[i], key=lambda r: r["piece"])
        assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == cut
        assert [(r["piece"], r["start"], r["length"]) for r in got] == [(n, 4096 * n, len(c)) for n, c in enumerate(cut)]
        assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
    check_sequences(rows)
    assert packing.pack(docs.filter("false")).count() == 0


def check_sequences(rows):
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= 4096
    return len(used)


def test_packing_fills_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_BUCKET", 100)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert check_sequences(rows) <= sum(r["length"] for r in rows) / 4096 * 1.02 + 1


texts = st.text(alphabet=st.sampled_from(list("<>/|s[]INSTY\\\n im_endoftx")), max_size=40)


@given(st.lists(st.tuples(texts, texts), max_size=6))
@settings(max_examples=300, deadline=None)
def test_rendered_turns_read_back(turns):
    output = "".join(chat.render(role, text) for role, text in turns)
    found, at = chat.parse(output)
    assert at == len(output) and [(r, t) for r, t, *_ in found] == turns
    for (_, text), (*_, a, b) in zip(turns, found, strict=True):
        assert chat.unescape(output[a:b]) == text
        assert not any(c in output[a:b] for c in chat.CONTROL)


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 0, 0, "message", "system", "be kind"),
        (1, 1, 0, "message", "user", "hi"),
        (1, 1, 5, "edit", None, "hello"),
        (1, 2, 3, "delta", None, " there"),
        (1, 2, 1, "delta", "assistant", "wrong"),
        (1, 2, 2, "regenerate", None, None),
        (1, 3, 0, "message", "user", None),
        (1, 3, 1, "message", "user", "twice"),
        (None, 0, 0, "delta", "user", "no id"),
        (2, None, 0, "edit", "assistant", "only </s>"),
    ]
    random.Random(4).shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    events = events.withColumns({c: F.lit("x") for c in ("message", "output", "loss")})
    rows = chat.formatted(events).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["message"]):
        got[r["conv_id"]].append(tuple(x[:2] for x in chat.parse(r["output"])[0])[0] + (r["loss"],))
    assert got[1] == [("system", "be kind", False), ("user", "hello", False), ("assistant", " there", True), ("user", "", False), ("user", "twice", False)]
    assert got[None] == [("user", "no id", False)] and got[2] == [("assistant", "only </s>", True)]
    digests = {r["conv_id"]: r for r in chat.digests(chat.formatted(events)).collect()}
    assert digests[1]["n_turns"] == 5 and digests[1]["loss_chars"] == 6
    assert digests[2]["loss_sha256"] == hashlib.sha256(b"only </s>").hexdigest()
    assert digests[1]["formatted_chars"] == sum(len(r["output"]) for r in rows if r["conv_id"] == 1)
    assert chat.digests(chat.formatted(events.filter("false"))).count() == 0


def test_unknown_events_fail():
    with pytest.raises(ValueError):
        list(chat.fold(iter([(1, 0, "undo", "user", "x")])))


def test_one_conversation_may_hold_most_rows(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(20_000)] + [(i + 10, 0, "user", "x") for i in range(50)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.formatted(chat.message_events(table))).collect()}
    assert Counter(got.values()) == {20_000: 1, 1: 50}


def test_marked_pieces_give_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(8)
    path = packing.tokenizer_path()
    whole, chunks = Tokenizer.from_file(path), packing.ChunkIds(path)
    letters = "etaoinshrdlu" * 3 + "cmfwypvbgkjqxzETAS" + "éèüßñçãæøÀÉŒœſıªºµ" + "0123456789²½" + "'’“”–—….,;:!?()\"#*$%&|<>_-\x7f\x80"
    texts = ["".join(rng.choice(letters + "  \n\t\xa0") for _ in range(rng.randrange(0, 300))) for _ in range(3000)]
    settled = [c for c in map(chr, range(0x2028)) if packing._SETTLED.fullmatch(c) and c != packing.MARK]
    texts += [f"a{c}b {c}{c} {c}'s9{c}" for c in settled] + ["", " ", "İ", "İ", "<|endoftext|>", "'ll 'LL it's"]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert chunks.marked is not None and chunks.encode(texts) == want
    assert packing.marked_encoding(packing.tokenizer_path("byte_bpe_50k.json")) is None
