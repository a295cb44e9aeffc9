"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is its own measurements and those of the lines before and after it; the
chain adds how likely good and bad follow each other. Forward-backward gives each line its marginal probability of being
good; their length-weighted mean, calibrated by a logistic curve, is the document's score.

Only whole documents are labelled. Lines start with their document's label; after a first fit, lines of bad documents
that look good are relabelled (the worst stays bad) and the field is fitted again. The fit uses at most
``SAMPLE_DOCS`` labelled documents of at most ``SAMPLE_LINES`` lines, chosen by a hash of the id among rows whose
crc32(id) mod 5 is not 0; the sample is bounded, so it is fitted in the driver. Its features travel as 4-byte numbers of
each line alone (at most 70 MB); neighbours are added in the driver.

Scoring covers every whole text. Short chains run together, at most ``CELLS`` lines at once. A chain of more than
``LONG_CHAIN`` lines is cut into segments: the transfer matrix of each is made first, messages then pass from segment to
segment, and with both ends known the segments run like chains of their own. The marginals are those of the uncut chain;
beside the text and its lines a worker holds some numbers a line and one block of segments.

Defined cases: very long texts as above; null and empty texts have one empty line and score what an undecided document scores; repeated rows get
equal scores; ids may be null (then not held out); labels other than 0 and 1, null ones and those of unknown ids are not
learnt from; without labels of both kinds every score is 0.5; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

FOLDS = 5
SAMPLE_DOCS = 4000
SAMPLE_LINES = 400
THRESHOLD = 0.3
EPOCHS, RATE, PENALTY = 150, 0.05, 1e-3
DOCS_AT_ONCE = 256
#: Lines, padding included, that go through the recursions together; chains beyond the second number run in segments.
CELLS = 1 << 18
LONG_CHAIN = 4096
SYMBOLS = "#*$%&|<>!"
N_OWN = 11


def line_features(lines: list[str], seen: set[str] | None = None) -> np.ndarray:
    """Measurements of each line, about 0 to 1 each; ``seen`` holds the text's earlier lines and takes up these."""
    out = np.zeros((len(lines), N_OWN), np.float64)
    seen = set() if seen is None else seen
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if not n:
            out[i, 0] = 1.0
            continue
        chars = len(line)
        distinct = len(set(words))
        symbols = sum(map(line.count, SYMBOLS))
        upper = sum(map(str.isupper, words))
        runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[i] = (
            0.0,
            min(np.log1p(n) / 6, 1.5),
            min(symbols / n, 2.0),
            upper / n,
            1 - distinct / n,
            runs / n,
            min(line.count("|") / n, 1.0),
            min((chars - n + 1) / n / 10, 2.0),
            float(line in seen),
            float(n < 4),
            float(line.rstrip().endswith((".", "?", "!"))),
        )
        seen.add(line)
    return out


def _own(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line by itself; the lines' lengths."""
    lines = (text or "").split("\n")
    return line_features(lines), np.array([len(x) for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of each line, those of the lines before and after it, and a constant."""
    edge = np.zeros((1, N_OWN), own.dtype)
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    return np.hstack([own, before, after, np.ones((len(own), 1), own.dtype)])


def evidence_of(text: str | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``with_neighbours(own) @ weights`` without making that matrix; the lines' lengths."""
    lines = (text or "").split("\n")
    parts, seen = [], set()
    by_place = weights[:-1].reshape(3, N_OWN).T
    for at in range(0, len(lines), LONG_CHAIN):
        parts.append(line_features(lines[at : at + LONG_CHAIN], seen) @ by_place)
    own = np.vstack(parts)
    out = own[:, 0] + weights[-1]
    out[1:] += own[:-1, 1]
    out[:-1] += own[1:, 2]
    return out, np.fromiter(map(len, lines), np.float64, len(lines))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), n.max(), *rows[0].shape[1:]), rows[0].dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, np.arange(n.max()) < n[:, None]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def forward_backward(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the state good and of each pair of neighbouring states; ``scores`` are evidence for good.

    Lines beyond a chain's end (``mask`` false) carry no evidence and leave the messages as they are.
    """
    b, t = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], -1)
    fwd, bwd = np.zeros((b, t, 2)), np.zeros((b, t, 2))
    fwd[:, 0] = emit[:, 0]
    for i in range(1, t):
        new = _lse(fwd[:, i - 1, :, None] + trans, 1) + emit[:, i]
        fwd[:, i] = np.where(mask[:, i, None], new, fwd[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = _lse(trans + (emit[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
        bwd[:, i] = np.where(mask[:, i + 1, None], new, bwd[:, i + 1])
    total = _lse(fwd[:, -1], 1)
    good = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None])
    pairs = np.exp(
        fwd[:, :-1, :, None] + trans + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None]
    )
    return good * mask, pairs * mask[:, 1:, None, None]


def long_marginals(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals of the state good along one chain, in segments that pass messages on."""
    rest = scores[1:]
    if not len(rest):
        return 1 / (1 + np.exp(-scores))
    width = min(int(np.ceil(np.sqrt(len(rest)))), LONG_CHAIN)
    count = -(-len(rest) // width)
    emit = np.zeros(count * width)
    emit[: len(rest)] = rest
    emit = emit.reshape(count, width)
    mask = np.arange(count * width).reshape(count, width) < len(rest)

    def onward(state: np.ndarray, rows: slice, i: int) -> np.ndarray:
        """Messages (..., 2) after line i of the segments ``rows``; padding leaves them as they are."""
        shape = (-1,) + (1,) * (state.ndim - 2)
        new = _lse(state[..., :, None] + trans, -2)
        new[..., 1] += emit[rows, i].reshape(shape)
        return np.where(mask[rows, i].reshape((*shape, 1)), new, state)

    # From each state before a segment to each state at its end.
    moves = np.broadcast_to(np.where(np.eye(2) > 0, 0.0, -np.inf), (count, 2, 2))
    for i in range(width):
        moves = onward(moves, slice(None), i)
    into, out_of = np.zeros((count + 1, 2)), np.zeros((count + 1, 2))
    into[0] = 0.0, scores[0]
    for k in range(count):
        into[k + 1] = _lse(into[k, :, None] + moves[k], 0)
        into[k + 1] -= into[k + 1].max()
    for k in range(count - 1, -1, -1):
        out_of[k] = _lse(moves[k] + out_of[k + 1], 1)
        out_of[k] -= out_of[k].max()

    def share(messages: np.ndarray) -> np.ndarray:
        return np.exp(messages[..., 1] - _lse(messages, -1))

    good = np.empty((count, width))
    for at in range(0, count, max(CELLS // width, 1)):
        rows = slice(at, min(at + max(CELLS // width, 1), count))
        fwd = np.empty((rows.stop - at, width, 2))
        state = into[at : rows.stop]
        for i in range(width):
            state = fwd[:, i] = onward(state, rows, i)
        state = out_of[at + 1 : rows.stop + 1]
        for i in range(width - 1, -1, -1):
            good[rows, i] = share(fwd[:, i] + state)
            ahead = state.copy()
            ahead[:, 1] += emit[rows, i]
            state = np.where(mask[rows, i, None], _lse(trans + ahead[:, None, :], 2), state)
    return np.concatenate([[share(into[0] + out_of[0])], good.ravel()[: len(rest)]])


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    trans: tuple[tuple[float, float], tuple[float, float]]
    slope: float
    shift: float

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        """Quality of each text, in the order given; chains of similar length run together."""
        w, trans = np.array(self.weights), np.array(self.trans)
        evidence, lengths, means = [], [], []
        for text in texts:
            s, n = evidence_of(text, w)
            if len(s) > LONG_CHAIN:
                means.append(weighted(long_marginals(s, trans), n))
                s = n = np.empty(0)
            else:
                means.append(0.0)
            evidence.append(s)
            lengths.append(n)
        order = sorted((i for i in range(len(means)) if len(lengths[i])), key=lambda i: len(lengths[i]))
        for part in _together([len(lengths[i]) for i in order]):
            s, mask = _padded([evidence[order[i]] for i in part])
            good, _ = forward_backward(s, mask, trans)
            for row, i in enumerate(part):
                n = lengths[order[i]]
                means[order[i]] = weighted(good[row, : len(n)], n)
        return (1 / (1 + np.exp(-(self.slope * np.array(means) + self.shift)))).tolist()


def _together(sizes: list[int]) -> Iterator[range]:
    """Ranges of ascending ``sizes`` that stay within ``DOCS_AT_ONCE`` chains and ``CELLS`` lines, padding included."""
    start = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= DOCS_AT_ONCE or (i + 1 - start) * size > CELLS):
            yield range(start, i)
            start = i
    if sizes:
        yield range(start, len(sizes))


def weighted(good: np.ndarray, lengths: np.ndarray) -> float:
    total = lengths.sum()
    return float((good * lengths).sum() / total) if total else 0.5


def _adam(grad, x: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, rounds + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return x


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """A model from (features, line lengths, label) of documents; ordered input gives equal results."""
    k = 3 * N_OWN + 1
    if len({y for _, _, y in docs}) < 2:
        return Model((0.0,) * k, ((0.0, 0.0), (0.0, 0.0)), 0.0, 0.0)
    docs = sorted(docs, key=lambda d: len(d[0]))
    groups = [docs[i : i + DOCS_AT_ONCE] for i in range(0, len(docs), DOCS_AT_ONCE)]
    packed = [_padded([x for x, _, _ in g]) for g in groups]
    labels = [np.repeat(np.array([[y] for *_, y in g], float), p[1].shape[1], 1) * p[1] for g, p in zip(groups, packed, strict=True)]
    lines = sum(mask.sum() for _, mask in packed)

    def gradient(params: np.ndarray) -> np.ndarray:
        w, trans = params[:k], params[k:].reshape(2, 2)
        g = np.zeros_like(params)
        for (x, mask), y in zip(packed, labels, strict=True):
            good, pairs = forward_backward(x @ w, mask, trans)
            g[:k] += np.einsum("bt,btk->k", good - y, x)
            a, b, both = y[:, :-1], y[:, 1:], mask[:, 1:]
            real = [[((1 - a) * (1 - b) * both).sum(), ((1 - a) * b * both).sum()], [(a * (1 - b) * both).sum(), (a * b * both).sum()]]
            g[k:] += (pairs.sum((0, 1)) - np.array(real)).ravel()
        return g / lines + PENALTY * params

    params = _adam(gradient, np.zeros(k + 4), EPOCHS, RATE)
    w, trans = params[:k], params[k:].reshape(2, 2)
    for (x, mask), y, group in zip(packed, labels, groups, strict=True):
        good, _ = forward_backward(x @ w, mask, trans)
        for row, (*_, label) in enumerate(group):
            if label == 0:
                n = int(mask[row].sum())
                y[row, :n] = good[row, :n] > 0.5
                y[row, int(good[row, :n].argmin())] = 0.0
    params = _adam(gradient, params, EPOCHS, RATE)
    w, trans = params[:k], params[k:].reshape(2, 2)
    means, truth = [], []
    for (x, mask), group in zip(packed, groups, strict=True):
        good, _ = forward_backward(x @ w, mask, trans)
        for row, (_, lengths, label) in enumerate(group):
            means.append(weighted(good[row, : len(lengths)], lengths))
            truth.append(label)
    m, t = np.array(means), np.array(truth, float)

    def curve(p: np.ndarray) -> np.ndarray:
        e = 1 / (1 + np.exp(-(p[0] * m + p[1]))) - t
        return np.array([(e * m).mean(), e.mean()]) + 1e-4 * p

    slope, shift = _adam(curve, np.array([4.0, -2.0]), 2000, 0.05)
    return Model(tuple(w), tuple(map(tuple, trans.tolist())), float(slope), float(shift))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    given = labels.select(F.col(id_col).alias("label_id"), F.col("quality").cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id"))
    )
    one = given.groupBy("label_id").agg(F.max("y").alias("y"))
    # At most ``sample`` rows: a bounded broadcast.
    chosen = F.broadcast(one.orderBy(F.xxhash64("label_id"), "label_id").limit(sample))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, y, text in zip(*batch.columns, strict=True):
                text = text.as_py() or ""
                if text.count("\n") < SAMPLE_LINES:
                    x, n = _own(text)
                    out.append((i.as_py(), y.as_py(), x.astype("<f4").tobytes(), n.astype("<i4").tobytes()))
            if out:
                kinds = [batch.schema.field(0).type, pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "y", "x", "n"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(chosen, rows["id"] == chosen["label_id"]).select("id", "y", "text")
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"id {kind}, y int, x binary, n binary").collect()
    by_id = {r["id"]: r for r in sorted(got, key=lambda r: (r["id"], len(r["n"]), bytes(r["x"])))}

    def chain(r: Row) -> tuple[np.ndarray, np.ndarray, int]:
        own = np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, N_OWN)
        return with_neighbours(own), np.frombuffer(bytes(r["n"]), "<i4").astype(np.float64), r["y"]

    return fit([chain(r) for r in by_id.values()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = pa.array(model.scores(x.as_py() for x in part.column(2)), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
