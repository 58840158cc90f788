"""URL rules and the propagation against a dense power iteration, and the query against its SQL."""

from collections import Counter

import numpy as np
from check import compare, connect
from pyspark.sql import functions as F

from attestra.llm import hosts
from attestra.llm.queries import QUERIES, SQL, URL_RULES


def slow_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path


URLS = ["http://a.ORG/x", "https://org/", "http://org", "http://xorg/a", "http://sub.example.org/es/1", "http://example.org/en/1", "http://example.org/en/12?q",
        "http://example.org/en/2", "http://b.com/fr/1#x", "http://b.com/de/1", "http://b.com?x=/fr/", "//no/scheme", None, "", "a://b://c/d", "http://ÄB.com/fr/", "http://c.net/p"]


def test_rules(spark):
    rows = [(k, u, "") for k, u in enumerate(URLS)]
    got = {r["page_id"]: r for r in hosts.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    for k, url in enumerate(URLS):
        host, path = slow_split(url)
        fits = [(len(rule), rule, action) for action, rule in URL_RULES
                if (host == rule.split("/", 1)[0] or host.endswith("." + rule.split("/", 1)[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert got[k]["verdict"] == max(fits)[2]
    assert got[len(URLS) - 1]["verdict"] == "allow"


def test_propagation(spark):
    names = [f"h{k}" for k in range(12)]
    random = np.random.default_rng(3)
    links = {(a, b) for a, b in random.integers(0, 12, (40, 2)) if a != b}
    pages = [(names[a], f"http://{names[a]}/", f'<a class=x HREF="http://{names[b]}/q">l</a> <a href=\'//{names[b]}\'>again</a> <a href="/own">o</a>') for a, b in sorted(links)]
    edges = hosts.host_edges(spark.createDataFrame(pages, "page_id string, url string, html string"), "url", "html")
    seeds = spark.createDataFrame([("h0", 0.5, 0.0), ("h1", 0.5, 0.0), ("h2", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: r for r in hosts.propagate(seeds, edges, steps=20).collect()}
    matrix = np.zeros((12, 12))
    for a, b in links:
        matrix[a, b] = 1
    forward = matrix / np.maximum(1, matrix.sum(axis=1, keepdims=True))
    shares = forward.T / np.maximum(1e-300, forward.T.sum(axis=1, keepdims=True))
    for name, seed, move in (("trust", [0.5, 0.5, 0], forward), ("distrust", [0, 0, 1.0], shares)):
        seed = np.array(seed + [0] * 9)
        value = seed
        for _ in range(20):
            value = 0.15 * seed + 0.85 * value @ move
        assert np.allclose([got[n][name] if n in got else 0 for n in names], value, atol=1e-12)


def test_hosts_near_blocked_pages_are_blocked(spark):
    pages = [(1, "http://bad.com/de/1", ""), (2, "http://spam.net/a", '<a href="http://bad.com/de/1">x</a>'), (3, "http://good.org/a", '<a href="http://fine.net/">x</a>'), (4, "http://fine.net/b", None)]
    got = {r["page_id"]: r["verdict"] for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_long_chains_are_followed(spark):
    """Thirty hosts in a row to a blocked page: each of them is blocked, the one beside them is not."""
    pages = [(k, f"http://h{k}.net/", f'<a href="http://h{k + 1}.net/">x</a>' if k < 29 else '<a href="http://bad.com/de/1">x</a>') for k in range(30)]
    pages += [(30, "http://bad.com/de/1", ""), (31, "http://aside.net/", '<a href="http://fine.net/">x</a>')]
    got = {r["page_id"]: r["verdict"] for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {**{k: "block" for k in range(31)}, 31: "allow"}


def test_query(spark, small):
    assert compare(QUERIES["op2_url_filter"](spark, small), connect(small), SQL["op2_url_filter"]) is None


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "http://x.org/", "<a href="), (1, "http://x.org/", "<a href="), (2, "x" * 100_000 + "://y/z", "<a href='http://q'" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("host", "path", "rule", "action", "_key", "good", "score")])
    got = hosts.judge(df, URL_RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(r["page_id"] for r in got.collect()) == {None: 1, 1: 2, 2: 1}
    assert hosts.judge(df.limit(0), URL_RULES).collect() == []
