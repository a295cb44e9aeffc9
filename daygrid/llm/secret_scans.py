r"""Multipart credential linking with DataFrame functions only.

Base finds are complete on their own: an assignment with a value of 8+ characters, an access identifier of 16+, a run
of 32+ hex digits. Weak candidates mean little alone: a named account, a bare secret, an endpoint. They are reported
only where complementary parts co-occur: parts of different sorts whose intervals lie within ``SCOPE`` code points of
each other in one document without overlapping. A base find may be the other part.

Positions come from ``split`` and ``regexp_extract_all`` of one pattern: match i starts after pieces 0..i and matches
0..i-1, a running sum. The interval join is a semi-join on (row, cell): a candidate lies in the cells its interval
touches, a partner in those that its interval widened by the scope touches. Cells are ``SCOPE`` long and finds of a
kind do not overlap, so a cell holds a bounded number of parts however long the text is; no pairs are formed.

Defined cases: a null text is empty; without finds the counts are 0, ``spans`` is empty and ``base_sha256`` is the
digest of the empty string; rows get numbers of their own, so null, equal and repeated ids do not mix; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid.llm.common import fresh, stored, text_or_empty

#: Code points between the parts of one credential.
SCOPE = 200
#: What takes a secret's place in a text.
MARK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    """A kind of find: the sort of part it is, its pattern, the group whose length counts and its least length."""

    name: str
    sort: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which finds at one start are listed. Where a match is one run of characters, its least length stands
#: in the pattern: a shorter run has no match at all, and runs cannot overlap.
BASE = (
    Kind(
        "assign",
        "secret",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Kind("access", "id", r"AKIA[A-Z0-9]{12,}"),
    Kind("hex", "secret", r"[0-9a-f]{32,}"),
)
WEAK = (
    Kind("account", "id", r"(?i:account|client|user)_?(?i:id|name)\x20*[:=]\x20*[A-Za-z0-9_.@-]{4,}"),
    Kind("opaque", "secret", r"[A-Za-z0-9+/]{40,}"),
    Kind("endpoint", "endpoint", r"""(?:https?|postgres|mysql|redis|amqp)://[^\x20\x09-\x0D"'<>]{4,}"""),
)
KINDS = BASE + WEAK


def _matches(text: Column, number: int, kind: Kind, octets: bool = False) -> Column:
    """Every match of a kind: its place in the list, code points before it since the last one, its own, the group's.

    With ``octets``, the UTF-8 bytes before it and its own as well.
    """
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    rows = F.transform(
        F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), whole.alias("all"), counted.alias("counted")),
        lambda x, i: F.struct(
            F.lit(number).alias("kind"),
            i.alias("place"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["all"]).alias("width"),
            F.length(x["counted"]).alias("counted"),
            *([F.octet_length(x["gap"]).alias("gap_b"), F.octet_length(x["all"]).alias("width_b")] if octets else []),
        ),
    )
    more = ",gap_b:int,width_b:int" if octets else ""
    empty = F.array().cast(f"array<struct<kind:int,place:int,gap:int,width:int,counted:int{more}>>")
    # The piece after the last match has no match of its own.
    return F.when(F.size(whole) > 0, F.filter(rows, lambda x: x["width"].isNotNull())).otherwise(empty)


def matches(text: Column, octets: bool = False) -> Column:
    return F.concat(*[_matches(text, n, k, octets) for n, k in enumerate(KINDS)])


def _by_kind(column: Column, attribute: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(k, attribute)) for k in KINDS]), column + 1)


def parts(rows: DataFrame, octets: bool = False) -> DataFrame:
    """(row_no, kind, s, e, sort) of all matches that are long enough, from stored rows with ``m`` = ``matches``.

    With ``octets``, the bytes (sb, eb) too.
    """
    before = W.partitionBy("row_no", "m.kind").orderBy("m.place")
    end = F.sum(F.col("m.gap") + F.col("m.width")).over(before)
    more, names = [], []
    if octets:
        end_b = F.sum(F.col("m.gap_b") + F.col("m.width_b")).over(before)
        more, names = [(end_b - F.col("m.width_b")).alias("sb"), end_b.alias("eb")], ["sb", "eb"]
    return (
        rows.select("row_no", F.explode("m").alias("m"))
        .select("row_no", "m.kind", (end - F.col("m.width")).alias("s"), end.alias("e"), "m.counted", *more)
        .filter(F.col("counted") >= _by_kind(F.col("kind"), "least"))
        .select("row_no", "kind", "s", "e", _by_kind(F.col("kind"), "sort").alias("sort"), *names)
    )


def linked(found: DataFrame) -> DataFrame:
    """Base finds, and weak candidates with a complementary part within the scope: (row_no, kind, s, e).

    Bytes (sb, eb) are kept where ``found`` has them.
    """
    kept = ["row_no", "kind", "s", "e", *[c for c in ("sb", "eb") if c in found.columns]]
    cell = lambda c: F.floor(c / F.lit(SCOPE))
    weak = found.filter(F.col("kind") >= len(BASE)).withColumn(
        "cell", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e"))))
    )
    other = found.select(
        F.col("row_no").alias("r"),
        F.col("s").alias("s2"),
        F.col("e").alias("e2"),
        F.col("sort").alias("sort2"),
        F.explode(F.sequence(cell(F.col("s") - SCOPE), cell(F.col("e") + SCOPE))).alias("cell2"),
    )
    near = (
        (F.col("row_no") == F.col("r"))
        & (F.col("cell") == F.col("cell2"))
        & (F.col("sort") != F.col("sort2"))
        & (F.col("s2") <= F.col("e") + SCOPE)
        & (F.col("s") <= F.col("e2") + SCOPE)
        & ((F.col("e2") <= F.col("s")) | (F.col("e") <= F.col("s2")))
    )
    hits = weak.join(other, near, "left_semi").select(kept).distinct()
    return found.filter(F.col("kind") < len(BASE)).select(kept).unionByName(hits)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and ``finds``, an array of (s, kind number, e) by start, then kind."""
    rows = stored(
        docs.select(
            F.col(id_col),
            F.monotonically_increasing_id().alias("row_no"),
            matches(text_or_empty(text_col)).alias("m"),
        ),
        "secret-matches",
    )
    found = linked(parts(rows)).groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("s", "kind", "e"))).alias("finds"))
    empty = F.array().cast(found.schema["finds"].dataType)
    return rows.select(id_col, "row_no").join(found, "row_no", "left").select(
        id_col, F.coalesce("finds", empty).alias("finds")
    )


def summarised(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and listing of the finds of each row."""
    base = F.filter("finds", lambda x: x["kind"] < len(BASE))

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda x: F.concat_ws(":", _by_kind(x["kind"], "name"), x["s"], x["e"])), ","
        )

    count = lambda n: F.size(F.filter("finds", lambda x: x["kind"] == n)).cast("long")
    return found.select(
        id_col,
        *[count(n).alias(f"n_{k.name}") for n, k in enumerate(BASE)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("finds")).alias("spans"),
    )


def covered(finds: DataFrame) -> DataFrame:
    """(row_no, runs): the bytes (sb, eb) of each row that finds cover, overlapping finds as one run, in order."""
    order = W.partitionBy("row_no").orderBy("sb", "kind", "eb")
    reach = F.max("eb").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = finds.withColumn("new", F.coalesce(F.col("sb") >= reach, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order)).groupBy("row_no", "run")
    return (
        runs.agg(F.min("sb").alias("sb"), F.max("eb").alias("eb"))
        .groupBy("row_no")
        .agg(F.array_sort(F.collect_list(F.struct("sb", "eb"))).alias("runs"))
    )


def masked(text: Column, runs: Column, mark: str = MARK) -> Column:
    """``text`` with each of its ``runs`` replaced by ``mark``.

    What lies between is cut out of the bytes by place, each piece by itself, and joined once.
    """
    octets = text.cast("binary")
    between = F.transform(
        F.sequence(F.lit(0), F.size(runs)),
        lambda i: F.struct(
            F.coalesce(F.get(runs, i - 1)["eb"], F.lit(0)).cast("int").alias("from"),
            F.coalesce(F.get(runs, i)["sb"], F.octet_length(text)).cast("int").alias("to"),
        ),
    )
    pieces = F.transform(between, lambda x: F.substring(octets, x["from"] + 1, x["to"] - x["from"]).cast("string"))
    return F.array_join(pieces, mark)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, secrets in the text replaced by ``MARK``; ``chars_col`` follows where it is given.

    Texts are scanned once: rows are stored with their matches. Those without any pass straight through from there; only
    rows with finds meet them again.
    """
    m, no, hit = fresh(docs, "matches"), fresh(docs, "row_no"), fresh(docs, "hit")
    marked = docs.withColumn(m, matches(text_or_empty(text_col), octets=True))
    marked = marked.withColumn(no, F.monotonically_increasing_id()).withColumn(hit, F.size(m) > 0)
    rows = stored(marked, "secret-rows")
    named = rows.filter(F.col(hit)).select(F.col(no).alias("row_no"), F.col(m).alias("m"))
    found = covered(linked(parts(named, octets=True))).withColumnRenamed("row_no", "found_no")
    met = rows.filter(F.col(hit)).select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(no).alias("row_no"))
    met = met.join(found, F.col("row_no") == F.col("found_no"), "left")
    text = F.col("doc")[text_col]
    met = met.withColumn("new", F.when(F.col("runs").isNull(), text).otherwise(masked(text.cast("string"), F.col("runs"))))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("new").alias(c)
        if c == chars_col:
            kind = docs.schema[c].dataType
            return F.when(F.col("runs").isNull(), F.col("doc")[c]).otherwise(F.length("new").cast(kind)).alias(c)
        return F.col("doc")[c].alias(c)

    clean = rows.filter(~F.col(hit)).select(docs.columns)
    return clean.union(met.select(*[column(c) for c in docs.columns]))
