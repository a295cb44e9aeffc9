"""Rules, host scores and verdicts of url filters."""

import pytest

from daygrid.llm import url_filters as U

PAGES = [
    (1, "https://www.EXAMPLE.com/en/x?q", None),
    (2, "https://example.com/en/x", '<a href="https://blog.org/a">'),
    (3, "http://a.example.com/en/", "<a href='//spam.org/'>"),
    (4, "http://b.net/es/1#x", None),
    (5, "http://b.net", None),
    (6, "net/es/", None),
    (7, None, '<a href="http://blog.org">'),
    (8, "http://blog.org/p?x=://y.net/es/", '<a href="http://a.example.com/en/9">' * 3),
    (9, "http://spam.org/", '<A HREF = "HTTPS://A.example.com/en/">'),
    (10, "http://xnet/es/", ""),
    (10, "http://xnet/es/", ""),
    (None, "http://n.com?/", None),
]
SCHEMA = "page_id long, url string, html string"


def rows(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(PAGES, SCHEMA).withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "score")})
    return U.filter_urls(pages)


def test_rules_hosts_and_paths(spark):
    got = {}
    for r in rows(spark).collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"]))
    assert got[1] == [("www.example.com", "/en/x", "www.example.com/en/")]
    assert got[2] == [("example.com", "/en/x", "example.com/en/")]
    assert got[3] == [("a.example.com", "/en/", "example.com/en/")]
    assert got[4] == [("b.net", "/es/1", "net/es/")]
    assert got[5] == [("b.net", "", None)] and got[6] == got[7] == [("", "", None)]
    assert got[8] == [("blog.org", "/p", None)]
    assert got[10] == [("xnet", "/es/", None)] * 2 and got[None] == [("n.com", "", None)]


def test_scores_follow_the_links(spark):
    scores = {r["host"]: r for r in U.host_scores(spark.createDataFrame(PAGES, SCHEMA)).collect()}
    links = {("example.com", "blog.org"): 1, ("a.example.com", "spam.org"): 1, ("blog.org", "a.example.com"): 1, ("spam.org", "a.example.com"): 1}
    hosts = set(scores)
    assert {"blog.org", "spam.org", "xnet"} <= hosts
    bad = {"example.com": 1.0, "a.example.com": 1.0, "b.net": 0.5}
    seed = {h: bad.get(h, 0) / 2.5 for h in hosts}
    back = {}
    for (s, d), w in links.items():
        back.setdefault(d, []).append(s)
    score = dict(seed)
    for _ in range(U.ROUNDS):
        new = {h: 0.15 * seed[h] for h in hosts}
        for d, sources in back.items():
            for s in sources:
                new[s] += 0.85 * score[d] / len(sources)
        score = new
    for h in hosts:
        assert scores[h]["distrust"] == pytest.approx(score[h], abs=1e-9)
    assert score["spam.org"] > 0


def test_distrust_blocks_hosts_that_link_to_blocked_ones(spark):
    pages = [(i, f"http://h{i}.org/", None) for i in range(200)]
    pages += [(900 + i, f"http://x.net/es/{i}", None) for i in range(5)]
    pages += [(990, "http://feeder.org/", '<a href="http://x.net/es/1">')]
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[990] == "block" and got[900] == "block" and all(got[i] == "allow" for i in range(200))


def test_distrust_reaches_hosts_many_links_away(spark):
    pages = [(i, f"http://h{i}.org/", None) for i in range(300)]
    pages += [(900, "http://x.net/es/1", None), (1001, "http://c1.org/", '<a href="http://x.net/es/1">')]
    pages += [(1000 + i, f"http://c{i}.org/", f'<a href="http://c{i - 1}.org/">') for i in range(2, 13)]
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[1012] == "block" and all(got[i] == "allow" for i in range(300))


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0
