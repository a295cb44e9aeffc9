"""Vector bin packing: the plan's promises, and whole results against direct tokenisation."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daygrid.llm.instruction_packing import _ranks, encoder, pack, plan
from daygrid.llm.packing import tokenizer_path

CLASSES = st.dictionaries(
    st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.integers(0, n))), st.integers(1, 30), max_size=12
)
TEXTS = [
    None, "", " ", "a", "   b\n\n \t c  ", "Word's  don't x 　 y\x1cz", "<|endoftext|> in <|endoftext|>text", "漢字かな🙂é̀",
    "same text", "same text", "ACGT" * 3000, "1234567890 " * 700, "one two three. " * 4000,
]


def laid(pieces):
    """Sequences from (sequence, offset, length, loss); checks that they are gapless."""
    out = defaultdict(list)
    for sequence, offset, length, loss in pieces:
        out[sequence].append((offset, length, loss))
    for rows in out.values():
        end = 0
        for offset, length, _ in sorted(rows):
            assert offset == end and length > 0
            end += length
    return {s: (sum(r[1] for r in rows), len(rows), sum(r[2] for r in rows)) for s, rows in out.items()}


def power_of_two(n):
    return n & (n - 1) == 0


@settings(max_examples=200, deadline=None)
@given(CLASSES, st.integers(1, 8), st.integers(1, 40))
def test_plan_covers_each_item_and_pads_nothing(counts, segments, loss):
    cover, pieces = defaultdict(list), []
    for length, head, lo, hi, start, size, sequence, at in plan(counts, 40, segments, loss):
        for rank in range(lo, hi):
            cover[length, head, rank].append((start, size))
            pieces.append((sequence + rank - lo, at, size, size - max(0, min(head - start, size))))
    assert set(cover) == {(*k, rank) for k, n in counts.items() for rank in range(n)}
    for (length, _, _), parts in cover.items():
        assert sum(n for _, n in parts) == length
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), [*sorted(parts)[1:], (length, 0)], strict=True))
    for tokens, n, bearing in laid(pieces).values():
        assert n <= segments and bearing <= loss and (tokens == 40 or power_of_two(tokens))


def test_the_dot_product_chooses_what_the_room_has_most_of():
    # Loss is scarce: of two classes of the same length the one with more of it goes first, then prompts fill up.
    slots = plan({(6, 0): 1, (6, 6): 1, (4, 4): 1}, 10, 8, 6)
    first = [s[:2] for s in sorted(slots, key=lambda s: (s[6], s[7])) if s[6] == 0]
    assert first == [(6, 0), (4, 4)]


def test_short_pieces_do_not_run_out_of_company():
    # 63 short examples and a cut block to a sequence; blocks wait until all short ones have a place.
    used = laid((s[6] + k, s[7], s[5], s[5]) for s in plan({(3, 0): 630, (1024, 0): 100}) for k in range(s[3] - s[2]))
    assert len(used) <= -(-(630 * 3 + 100 * 1024) // 1024) + 10


def rows_of(spark, texts, **more):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return pack(docs, **more).collect()


def whole(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


@pytest.mark.parametrize("limits", [(1024, 64, 1024), (64, 3, 64), (1000, 8, 700)])
def test_pieces_are_the_tokens_of_the_texts(spark, limits):
    rows = rows_of(spark, TEXTS, capacity=limits[0], max_segments=limits[1], max_loss=limits[2], with_ids=True)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, ids in enumerate(whole(TEXTS)):
        end = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            own = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["start"] == end and r["doc_tokens"] == len(ids) and bytes(r["ids"]) == own
            assert r["ids_crc32"] == zlib.crc32(own)
            end += r["length"]
        assert end == len(ids)
    for tokens, n, bearing in laid((r["sequence_id"], r["offset"], r["length"], r["loss_tokens"]) for r in rows).values():
        assert n <= limits[1] and bearing <= limits[2] and (tokens == limits[0] or power_of_two(tokens))


def test_prompts_bear_no_loss(spark):
    rows = [(None, "one two three four", None, 1), (2, "one two three four", 2, 2), (2, "one two three four", 99, 3), (4, None, -5, 4)]
    docs = spark.createDataFrame(rows, "ROW_NO long, body string, prompt long, ids int")
    out = pack(docs, id_col="ROW_NO", text_col="body", prompt_col="prompt", max_loss=4).collect()
    loss = defaultdict(int)
    for r in out:
        loss[r["doc_id"], r["doc_tokens"]] += r["loss_tokens"]
    assert loss == {(None, 5): 5, (2, 5): 3, (4, 1): 1}
    assert all(v[2] <= 4 for v in laid((r["sequence_id"], r["offset"], r["length"], r["loss_tokens"]) for r in out).values())


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def test_other_tokenizers_take_their_own_library():
    import json

    path = tokenizer_path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        assert _ranks(json.load(file)) is None
    assert encoder(path)("Two words").tolist() == encoder(path)("two  words").tolist()
