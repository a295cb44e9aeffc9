"""Runs against all pairs of words compared directly; ends and steps of the suffix structures."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daygrid.llm.periodic_runs import collapse, common_prefixes, planted, runs_in, shared_least, sort_suffixes


def plain_runs(words, min_length=24, min_exponent=3):
    """For each period the maximal stretches that keep it; of those with one extent the smallest period stays."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(min_length, min_exponent * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, length, q) for (s, length), q in found.items() if all(
        any(words[i] != words[i + p] for i in range(s, s + length - p)) for p in range(1, q)
    ))


def plain_row(doc_id, text):
    """A row of the contract, from the text and nothing else."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


PARTS = st.lists(
    st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), st.integers(1, 14)), max_size=6
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=4), st.sampled_from([(24, 3), (6, 3), (4, 2)]))
def test_runs_of_stretches(docs, limits):
    texts = [[w for part, times in parts for w in part * times] for parts in docs]
    found = runs_in(texts, min_length=limits[0], min_exponent=limits[1])
    assert found == [plain_runs(t, *limits) for t in texts]


def fibonacci(n):
    a, b = b"a", b"ab"
    while len(b) < n:
        a, b = b, b + a
    return [bytes([x]) for x in b[:n]]


@pytest.mark.parametrize(
    "words",
    [
        [b"x"] * 1000, [b"x"] * 23, [b"x"] * 24, [b"a", b"b"] * 500, fibonacci(700), ([b"a"] * 30 + [b"b"]) * 5,
        ([b"a", b"b", b"a"] * 9 + [b"c"]) * 4, [b"p%d" % (i % 8) for i in range(24)], [b"p%d" % (i % 9) for i in range(26)],
        [b"b"] * 40 + [b"a"] * 40, [b"z", *[b"y", b"x"] * 20, b"y", b"z"] * 3,
    ],
    ids=range(11),
)
def test_worked_stretches(words):
    assert runs_in([words, [], words]) == [plain_runs(words), [], plain_runs(words)]


def test_all_short_texts():
    import itertools

    texts = [[b"ab"[k : k + 1] for k in t] for n in range(11) for t in itertools.product((0, 1), repeat=n)]
    assert runs_in(texts, min_length=3, min_exponent=2) == [plain_runs(t, 3, 2) for t in texts]


def test_suffixes_are_sorted_and_prefixes_counted():
    rng = random.Random(4)
    for _ in range(30):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 80))]
        rank, _ = sort_suffixes(np.array(words), np.zeros(len(words), np.int64), 1)
        sa = sorted(range(len(words)), key=lambda i: words[i:])
        assert [int(x) for x in np.argsort(rank)] == sa
        isa = [0] * len(sa)
        for k, i in enumerate(sa):
            isa[i] = k
        lcp = common_prefixes(words, sa, isa)
        for k in range(1, len(sa)):
            a, b = words[sa[k - 1] :], words[sa[k] :]
            assert lcp[k] == next((h for h in range(min(len(a), len(b))) if a[h] != b[h]), min(len(a), len(b)))


def test_least_shared_words():
    assert shared_least() == 16
    for q in range(1, 100):
        assert max(24, 3 * q) - q >= shared_least()


def test_rows_of_a_table(spark):
    rng = random.Random(7)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 300)))) for i in [*ids, *range(1, 20)]]
    rows += [
        (50, None), (51, ""), (52, " \t\n"), (None, "w " * 30), (53, "　é " * 25 + "end"), (53, "　é " * 25 + "end"),
        (54, "one\x0btwo\x0cthree\r" * 10), (55, "long " + "in and out " * 150_000), (ids[0], " ".join(map(str, range(5000)))),
    ]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "Doc_Id long, text string, n_runs int, START string")
    out = collapse(docs, with_runs=True, change=planted).collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    short = [r for r in rows if r[0] != 55]
    got = sorted((str(r["doc_id"]), *map(str, (r[c] for c in names))) for r in out if r["doc_id"] != 55)
    assert got == sorted((str(i), *map(str, plain_row(i, t))) for i, t in short)
    (long,) = [r for r in out if r["doc_id"] == 55]
    assert long["n_runs"] == 1 and long["runs"][0].asDict() == {"start": 1, "length": 450_000, "period": 3}
    assert long["collapsed"] == "long in and out"


def test_empty_table(spark):
    assert collapse(spark.createDataFrame([], "doc_id long, text string")).collect() == []
