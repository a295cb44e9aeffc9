"""Jaccard join, embedding dedup and repeated strings against brute force, with odd rows and hot groups."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from daygrid.llm import embedding_dedup, graph, signature_join, suffix_dedup
from daygrid.llm.common import WordHashes


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    links += [(5000, 5001 + i) for i in range(500)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "u long, v long")).collect()))
    want = roots({x for link in links for x in link}, links)
    least = {}
    for n, r in want.items():
        least[r] = min(least.get(r, n), n)
    assert got == {n: least[r] for n, r in want.items() if any(n in link and link[0] != link[1] for link in links)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingled(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def joined(texts):
    """Class of each row by brute force, as the least position."""
    sets = [shingled(t) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                links.append((i, j))
    root = roots(range(len(texts)), links)
    least = {}
    for i in sorted(root, reverse=True):
        least[root[i]] = i
    return [(len(s), least[root[i]]) for i, s in enumerate(sets)]


def near_copies(rng, n_bases=12, copies=25):
    texts = [None, "", " \n", "one", "One", "two words", "TWO words"]
    for b in range(n_bases):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 20, 60, 300]))]
        for _ in range(rng.randint(1, copies)):
            changed = [w if rng.random() > 0.02 else f"x{rng.randint(0, 9)}" for w in words]
            texts.append(rng.choice([" ", "\n"]).join(changed) + rng.choice(["", " common ending of many texts here it is"]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1024, 16])
def test_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(signature_join, "BLOCK", block)
    monkeypatch.setattr(signature_join, "GATHERED", 3000)
    texts = near_copies(random.Random(block), copies=40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    docs = docs.withColumns({c: F.lit("x") for c in ("set_key", "n", "found", "n_shingles", "sid")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in signature_join.join(docs).collect()}
    assert got == dict(enumerate(joined(texts)))


def test_keep_one_matches_brute_force(spark):
    texts = near_copies(random.Random(5), copies=12)
    component = {i: c for i, (_, c) in enumerate(joined(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7).withColumn("Row_No", F.lit("x"))
    again = docs.unionByName(docs)
    for rows, copies in ((docs, 1), (again, 2)):
        kept = Counter(r["doc_id"] for r in signature_join.keep_one(rows).collect())
        wordless = {i for i, t in enumerate(texts) if not (t or "").split()}
        assert kept == Counter({i: copies if i in wordless else 1 for i, c in component.items() if i == c})


def test_join_on_odd_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "other text"), (None, "A b c d e F"), (None, None), (1, "other TEXT"), (4, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set_key", F.lit(1))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in signature_join.join(docs).collect())
    assert got == Counter({(3, 2, 3): 2, (3, 1, 1): 1, (None, 2, 3): 1, (None, 0, None): 1, (1, 1, 1): 1, (4, 1, 4): 1})
    kept = signature_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([3, None, 1, 4])
    assert signature_join.join(docs.filter("false")).count() == 0 and signature_join.keep_one(docs.filter("false")).count() == 0


def test_trees_find_what_pairs_find():
    rng = random.Random(8)
    hashes = WordHashes()
    for _ in range(5):
        sets = [s for t in near_copies(rng) if len(s := signature_join.shingles(t, hashes))]
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if signature_join.linked(sets[i], sets[j])]
        want = roots(range(len(sets)), pairs)
        got = roots(range(len(sets)), signature_join.dual_traversal(sets, None))
        assert len(set(want.values())) == len(set(got.values())) and all(got[i] == got[j] for i, j in pairs)
        half = len(sets) // 2
        across = signature_join.dual_traversal(sets[:half], sets[half:])
        assert all(signature_join.linked(sets[i], sets[j]) for i, j in across)
        both = roots(range(len(sets)), [*across, *((i, j) for i, j in pairs if (i < half) == (j < half))])
        assert all(both[i] == both[j] for i, j in pairs)


def compared(rows):
    """(n_links, component) of each row by brute force; ids must differ."""
    ok = lambda v, y: y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = []
    for i, (_, v, y) in enumerate(rows):
        for j in range(i):
            _, w, z = rows[j]
            if ok(v, y) and ok(w, z) and y == z and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links.append((i, j))
    n = Counter(x for link in links for x in link)
    root, least = roots(range(len(rows)), links), {}
    for i, r in root.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return {rows[i][0]: (n[i], least[root[i]]) for i in range(len(rows))}


@pytest.mark.parametrize("dim", [64, 3])
def test_embeddings_match_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(dim)
    rows = []
    for _ in range(60):
        base = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 4))):
            rows.append((base + rng.normal(size=dim) * 0.05).astype(np.float32).tolist())
    hot = rng.normal(size=dim)
    rows += [(hot + rng.normal(size=dim) * 0.02).astype(np.float32).tolist() for _ in range(60)]
    rows += [rows[0], rows[0], [0.0] * dim, [float("nan")] * dim, [None] * dim, [], None, [float("inf")] + [1.0] * (dim - 1), [1e-30] * dim, [1e30] * dim]
    data = [(100 + i, v, None if i % 31 == 5 else i % 2 if i < 40 else 1) for i, v in enumerate(rows)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x"))
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(table).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == compared(data)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.dedup(table.filter("false")).count() == 0


def stripped(texts):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) by brute force."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(b and (i == 0 or not gone[i - 1]) for i, b in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def passages(rng):
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (75, 90, 100, 150, 400)]
    texts = [None, "", "x" * 399, "y" * 401, "z" * 400, "ab" * 700, "short"]
    for _ in range(60):
        parts = [prose(rng.randint(0, 200)) for _ in range(3)]
        texts.append(" ".join(rng.choice(parts + shared) for _ in range(rng.randint(1, 5))))
    for _ in range(25):
        a, b = sorted((rng.randint(0, 600), rng.randint(0, 600)))
        texts.append(prose(20) + shared[4][a : b + 420] + prose(5))
    texts += [texts[9]] * 3 + ["y" * 30 + "x" * 500, texts[10] + "!"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("batches", [1, 4])
def test_repeated_strings_match_brute_force(spark, batches):
    texts = passages(random.Random(batches))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    docs = docs.withColumns({c: F.lit("x") for c in ("class", "n_bytes", "data", "starts", "key")})
    rows = suffix_dedup.dedup(docs, batches=batches, with_kept=True).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    want = dict(enumerate(stripped(texts)))
    assert got == want
    for r in rows:
        left = bytes(r["kept"]) if r["kept"] is not None else (texts[r["doc_id"]] or "").encode()
        assert hashlib.sha256(left).hexdigest() == r["kept_sha256"]


def test_repeated_strings_on_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(1, text), (1, text), (None, "x" + text), (None, None), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup(docs).collect())
    n = len(text)
    assert got == sorted([(n, n), (n, n), (n + 1, n), (0, 0), (5, 0)])
    assert suffix_dedup.dedup(docs.filter("false")).count() == 0


def heads_of(spark, heads):
    rows = [(bytearray(h), int.from_bytes(hashlib.sha256(h).digest()[:7], "big")) for h in heads]
    return spark.createDataFrame(rows, "head binary, key long")


def arrayed(level):
    """Rows of a level in the order of its files."""
    return [r for name in sorted(level.inputFiles()) for r in pq.read_table(name.removeprefix("file://")).to_pylist()]


def test_index_levels_merge_geometrically(spark):
    index, matched = suffix_dedup.IndexFamily(), []
    head = lambda k: str(k).encode().rjust(suffix_dedup.PREFIX)
    batches = [[1, 2, 3], [3, 4], [5, 5], [1, 6], [7], [2], [8], [9, 1]]
    number = {r["key"]: k for k in range(1, 10) for r in heads_of(spark, [head(k)]).collect()}
    for b in batches:
        found = index.insert(heads_of(spark, map(head, b)))
        matched.append({number[r["key"]] for r in found.collect()})
    assert matched == [set(), {3}, {5}, {1}, set(), {2}, set(), {1}]
    assert sorted((size for size, _ in index.levels), reverse=True) == [4, 2, 1, 1]
    index.insert(heads_of(spark, [head(99)]))
    assert [size for size, _ in index.levels] == [8, 1]
    assert index.levels[0][1].agg(F.sum("n")).first()[0] == sum(map(len, batches))


def test_levels_are_suffix_arrays(spark):
    rng = random.Random(5)
    width = suffix_dedup.PREFIX
    # Few letters and bytes above 127: long common beginnings, and an order of unsigned bytes.
    make = lambda: bytes(rng.choice(b"a\x00\xe9") for _ in range(rng.choice([3, 8, width]))).rjust(width, b"q")
    index, seen = suffix_dedup.IndexFamily(), Counter()
    for _ in range(4):
        own = [make() for _ in range(400)]
        known = Counter(seen)
        seen.update(own)
        index.insert(heads_of(spark, own))
        rows = arrayed(index.levels[-1][1])
        assert [r["head"] for r in rows] == sorted(set(own))
        every = sorted(seen)
        shared = [len(os.path.commonprefix(list(p))) for p in zip(every, every[1:], strict=False)]
        for r in rows:
            at = every.index(r["head"])
            twice = own.count(r["head"]) > 1 or known[r["head"]]
            assert r["longest"] == (width if twice else max(shared[max(at - 1, 0) : at + 1]))
    index._merge()
    assert [size for size, _ in index.levels] == [4]
    rows = arrayed(index.levels[0][1])
    assert [(r["head"], r["n"]) for r in rows] == sorted(seen.items())


def test_repeats_in_very_long_texts(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(str(rng.random()) for _ in range(n))
    shared = prose(30)
    texts = [prose(100_000) + shared + prose(10), prose(5) + shared, "a" * 1_000_000, prose(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(docs).collect()}
    # Bytes next to the passage may agree by chance.
    assert abs(got[0][0] - len(shared)) < 8 and got[0] == got[1]
    assert (got[2], got[3]) == ((1_000_000, 1), (0, 0))
