"""Quality rules as a ledger: every rule is evaluated once, policies only read its bits.

``ledger`` measures each text once and gives the measurements and one failure bit per rule; ``stored_ledger`` writes
them to the shared folder, so that any number of policies and ablations read that table and no text. A policy is a named,
versioned set of rules (a bit mask); it decides with one AND per document. ``keep_good``, which has to hand the texts on
and applies one policy, keeps the bits in flight.
``ablation`` counts documents per distinct bit pattern (at most 2^rules groups, combined map-side) and derives from
that small table what each policy rejects and what leaving out one rule would change.

Defined cases: a null text has no words and fails ``too_short``; an empty table gives an empty ledger; repeated rows
give repeated ledger rows; ids may be null; columns other than the id and the text are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import BLANKS, fresh, stored, words_of

#: Symbols of the base measurement (fixed value).
SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition measurement.
WINDOW = 8

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, "
    "n_word_runs long, n_letters long, n_upper long"
)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more.

    Windows get exact ids by doubling: ids of two halves are joined to the id of the whole. ``width`` is a power of 2.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    span = 1
    counts = np.empty(0, np.int64)
    while span < width:
        pair = ids[:-span] * (n + 1) + ids[span:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        span *= 2
    start = np.zeros(n + 1, np.int64)
    again = np.flatnonzero(counts[ids] > 1)
    start[again] += 1
    np.subtract.at(start, again + width, 1)
    return int((np.cumsum(start)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    ascii_bytes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    lower = int(((ascii_bytes >= 97) & (ascii_bytes <= 122)).sum())
    upper = int(((ascii_bytes >= 65) & (ascii_bytes <= 90)).sum())
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(operator.eq, words, islice(words, 1, None))),
        lower + upper,
        upper,
    )


def _measures(texts: pa.Array) -> pa.Array:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    rows = np.array([measure(x.as_py()) for x in texts], np.int64).reshape(-1, len(names))
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; it gets a function from a measurement's name to its column.

    Integers only, so every engine decides alike. Bits are never reused.
    """

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "too_short", lambda m: m("n_words") < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule(2, "symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule(3, "duplicate_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule(4, "short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule(5, "long_words", lambda m: m("word_chars") > 20 * m("n_words")),
    Rule(6, "capitals", lambda m: 100 * m("n_upper") > 60 * m("n_letters")),
    Rule(7, "word_runs", lambda m: 100 * m("n_word_runs") > 30 * m("n_words")),
)

#: Versioned policies: the rules that reject a document. A new version is a new entry; old decisions stay reproducible.
POLICIES = {
    "base@1": ("too_short", "repeated_windows"),
    "web@1": ("too_short", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "capitals", "word_runs"),
}
PRODUCTION = "web@1"


def policy_mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: r.mask for r in rules}
    mask = 0
    for name in POLICIES[policy]:
        mask |= by_name[name]
    return mask


def rejected(policy: str, bits: Column | str = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) != 0


def _bits(rules: tuple[Rule, ...], measurement: Callable[[str], Column] = F.col) -> Column:
    total = F.lit(0).cast("long")
    for rule in rules:
        total = total.bitwiseOR(F.when(rule.fails(measurement), F.lit(rule.mask)).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, measurements, ``fail_bits`` (bit set: the rule failed)."""
    measures = F.arrow_udf(_measures, MEASURES)
    rows = docs.select(F.col(id_col), measures(F.col(text_col).cast("string")).alias("m"))
    return rows.select(id_col, "m.*").withColumn("fail_bits", _bits(rules))


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``ledger`` written once; what is derived from it reads only the columns it needs."""
    return stored(ledger(docs, id_col, text_col, rules), "quality-ledger")


def with_verdict(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Add ``base_failed`` and ``kept`` of ``policy`` to a ledger."""
    return rows.withColumn("base_failed", rejected("base@1")).withColumn(
        "kept", ~F.col("base_failed") & ~rejected(policy)
    )


def keep_good(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with all their columns; row-local, so repeated rows and null ids stay."""
    measures = F.arrow_udf(_measures, MEASURES)
    m = fresh(docs, "measures")
    rows = docs.withColumn(m, measures(F.col(text_col).cast("string")))
    bits = _bits(RULES, lambda name: F.col(m)[name])
    return rows.filter(~rejected("base@1", bits) & ~rejected(policy, bits)).drop(m)


def ablation(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents rejected, documents that only this rule rejects, rejected without this rule.

    One aggregation of the ledger to bit patterns; the rest is bitwise work on at most 2^rules rows.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [
        F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.lit(policy_mask(p, rules)).cast("long").alias("mask"), F.lit(r.mask).cast("long").alias("rule_mask"))
        for p in policies
        for r in rules
        if policy_mask(p, rules) & r.mask
    ]
    hits = F.col("fail_bits").bitwiseAND(F.col("case.mask"))
    return (
        patterns.withColumn("case", F.explode(F.array(*cases)))
        .groupBy("case.policy", "case.rule")
        .agg(
            F.sum(F.when(hits != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(hits == F.col("case.rule_mask"), F.col("n")).otherwise(0)).alias("only_this_rule"),
            F.sum(F.when(hits.bitwiseAND(F.bitwise_not("case.rule_mask")) != 0, F.col("n")).otherwise(0)).alias(
                "rejected_without"
            ),
        )
    )
