"""URL rules, and for urls without a rule trust carried along links between hosts; DataFrame functions only.

A rule names a host with its subdomains and a path prefix; of the rules that fit, the longest wins. Hosts whose pages a
rule allows are trusted seeds, hosts whose pages a rule blocks are distrusted seeds, each weighted by its share of such
pages. Trust is a personalised PageRank along links; distrust is one against the links (who links to bad hosts earns
distrust). A host without a rule for a page is blocked where its distrust is at least ``BLOCK_AT`` times the mean score
and larger than its trust; else it is allowed.

The page table is read once for rules, hosts and links. Everything after works on one row per host and one per pair of
linked hosts, summed map-side; ranks cross iterations through stored tables, so the plan does not grow.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule, and no links: it is allowed; null
html has no links; links to the page's own host, or without a host, make no edge; repeated rows each get a row and count
as pages of their host; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import stored

DAMPING = 0.85
ROUNDS = 10
#: Summed change of scores between two stored tables at which ranks are settled.
SETTLED = 1e-9
#: Rounds between two stored tables.
STORE_EVERY = 5
#: Distrust, in multiples of the mean over all hosts, from which a host is blocked.
BLOCK_AT = 5.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct (text, verdict); null where none does. Rules are a parameter, not data."""
    chosen = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule struct) of every page."""
    url = F.col("url").cast("string")
    return (
        pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    )


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): a host's outgoing links to other hosts, shares of 1."""
    url = F.col("url").cast("string")
    links = F.regexp_extract_all(
        F.col("html").cast("string"), F.lit(r"""(?i:href)\x20*=\x20*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#"'\x20<>]+)"""), F.lit(1)
    )
    counted = (
        pages.select(host_of(url).alias("src"), F.explode(links).alias("to"))
        .select("src", host_of(F.concat(F.lit("x:"), "to")).alias("dst"))
        .filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != ""))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    out = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return counted.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def _with_mass(seeds: DataFrame) -> DataFrame:
    total = seeds.agg(F.sum("seed").alias("total")).scalar()
    return seeds.select("host", F.coalesce(F.try_divide(F.col("seed"), total), F.lit(0.0)).alias("seed"))


def page_rank(links: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """(host, score): PageRank of ``links`` (src, dst, weight) with jumps to ``seeds`` (host, seed; sums to 1).

    ``rounds`` None: as many as it takes to settle; a round shrinks the change by ``DAMPING``, so it ends.

    Mass that no link carries on stays out, so a host without links scores its own jump share; scores are comparable.
    """
    ranks = seeds.select("host", F.col("seed").alias("score"))
    last = ranks
    for n in count(1) if rounds is None else range(1, rounds + 1):
        flow = (
            links.join(ranks, links["src"] == ranks["host"])
            .groupBy("dst")
            .agg(F.sum(F.col("score") * F.col("weight")).alias("got"))
        )
        ranks = seeds.join(flow, seeds["host"] == flow["dst"], "left").select(
            "host", ((1 - DAMPING) * F.col("seed") + DAMPING * F.coalesce("got", F.lit(0.0))).alias("score")
        )
        if n % STORE_EVERY == 0 and (rounds is None or n < rounds):
            ranks = stored(ranks, "host-ranks")
            if rounds is None:
                old = last.select(F.col("host").alias("old_host"), F.col("score").alias("old"))
                change = ranks.join(old, F.col("host") == F.col("old_host")).agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
                if (change or 0.0) < SETTLED:
                    break
                last = ranks
    return ranks


def host_scores(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int | None = ROUNDS) -> DataFrame:
    """(host, trust, distrust, verdict) of every host with a page or a link to it."""
    share = lambda verdict: F.avg(F.when(F.col("rule.verdict") == verdict, 1.0).otherwise(0.0))
    links = stored(edges(pages), "host-links")
    own = judged(pages, rules).groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    linked_to = links.select(F.col("dst").alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))
    hosts = stored(
        own.unionByName(linked_to).filter("host != ''").groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad")),
        "hosts",
    )
    trust = page_rank(links, _with_mass(hosts.select("host", F.col("good").alias("seed"))), rounds)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    total = back.groupBy("src").agg(F.sum("weight").alias("total"))
    back = back.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("weight"))
    distrust = page_rank(back, _with_mass(hosts.select("host", F.col("bad").alias("seed"))), rounds)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host")
    scores = stored(scores, "host-scores")
    mean = scores.agg(F.avg("distrust").alias("mean")).scalar()
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= BLOCK_AT * mean) & (F.col("distrust") > F.col("trust"))
    return scores.select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page: the rule's verdict, else the host's."""
    scores = stored(host_scores(pages, rules, rounds).select("host", "verdict"), "host-verdicts")
    bad = scores.filter("verdict = 'block'").select(F.col("host").alias("bad_host"))
    rows = judged(pages, rules)
    return rows.join(bad, rows["host"] == bad["bad_host"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("rule.text").alias("rule"),
        F.coalesce(F.col("rule.verdict"), F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )
