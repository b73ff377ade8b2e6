"""URL rules and alias components against a plain version and the SQL."""

from __future__ import annotations

import re
import time

import duckdb
from pyspark.sql import functions as F

from outlay.llm.queries import OP2_SQL, URL_RULES
from outlay.llm.url_filter import filter_urls, link_address

RULES = "host string, path string, verdict string"
PAGES = "page_id long, url string, html string, host string, rule string, node string"

HTML = {
    1: '<html><head><link rel="canonical" href="https://b.example.com/de/2"></head>',
    3: "<LINK href='/de/4?x=1&amp;y=2' REL='canonical'>",
    5: '<meta http-equiv="refresh" content="0; url=http://example.net/target">',
    6: '<link rel="stylesheet" href="https://b.example.com/de/2"><p>canonical</p>',
    7: '<link rel="canonical" href="mailto:x@y.z"><link rel=canonical href=next/page>',
    8: '<link rel="canonical" href="//example.org/es/9">',
    9: '<link rel="canonical" href="#top">',
    21: '<link rel="canonical" href="../../es/./x/../9?a=/../b"><link rel=canonical',
    22: '<link rel="canonical" href="..">',
}
URLS = [
    (1, "http://a.example.net/x"),
    (2, "https://b.example.com/de/2#frag"),
    (3, "https://b.example.com/fr/3"),
    (4, "http://b.example.com/de/4?x=1&y=2"),
    (5, "https://c.example.net/start"),
    (6, "https://d.example.net/six"),
    (7, "https://e.example.net/dir/seven"),
    (8, "https://f.example.net/eight"),
    (9, "https://g.example.net/nine"),
    (10, "https://WWW.Example.ORG/en/123?q"),
    (11, "https://example.org/es/"),
    (12, "https://notexample.org/es/"),
    (13, "https://com/de/"),
    (14, "https://org"),
    (15, None),
    (16, "no scheme"),
    (17, "ftp://x.org/a://b.com/de/"),
    (18, "https://xn.com?/de/"),
    (19, "https://h.example.net/plain"),
    (20, ""),
    (20, ""),
    (21, "https://www.example.org/a/b/c"),
    (22, "https://j.example.com/de/k/l"),
]


def split(url: str | None) -> tuple[str, str, str | None]:
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    after = rest[len(host) :]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    return host, re.match(r"[^?#]*", after)[0], host + re.match(r"[^#]*", after)[0]


def judge(host: str, path: str, rules) -> tuple[str | None, str | None]:
    fits = [(len(h + p), v == "allow", len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def pages(spark):
    rows = [(i, u, HTML.get(i, "<p>none</p>" if i % 2 else None), "h", "r", "n") for i, u in URLS]
    return spark.createDataFrame(rows, PAGES)


def test_rules_and_aliases(spark):
    rules = spark.createDataFrame(list(URL_RULES), RULES)
    redirects = [("https://h.example.net/plain", "https://example.org/en/1"), ("https://h.example.net/plain", None), ("https://i.net/1", "https://example.net/target")]
    found = filter_urls(pages(spark), rules, spark.createDataFrame(redirects, "src string, dst string")).collect()
    assert len(found) == len(URLS)
    edges = [
        ("a.example.net/x", "b.example.com/de/2"), ("b.example.com/fr/3", "b.example.com/de/4?x=1&y=2"), ("c.example.net/start", "example.net/target"),
        ("e.example.net/dir/seven", "e.example.net/dir/next/page"), ("f.example.net/eight", "example.org/es/9"),
        ("www.example.org/a/b/c", "www.example.org/es/9?a=/../b"), ("j.example.com/de/k/l", "j.example.com/de/"),
        ("h.example.net/plain", "example.org/en/1"), ("i.net/1", "example.net/target"),
    ]
    groups: list[set[str]] = []
    for edge in edges:
        met = [g for g in groups if g & set(edge)]
        groups = [g for g in groups if g not in met] + [set(edge).union(*met)]
    for row in found:
        url = dict(URLS)[row.page_id]
        host, path, node = split(url)
        rule, verdict = judge(host, path, URL_RULES)
        if verdict is None:
            told = [judge(*split("x://" + n)[:2], URL_RULES)[1] for g in groups if node in g for n in g]
            verdict = "allow" if "allow" in told or "block" not in told else "block"
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict), url
    verdicts = {r.page_id: r.verdict for r in found}
    assert [verdicts[i] for i in (1, 3, 8, 19, 9)] == ["block", "allow", "block", "block", "allow"]


def test_sql_says_the_same(spark, tmp_path):
    rows = pages(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    want = sorted(con.execute(OP2_SQL).fetchall(), key=str)
    got = filter_urls(rows, spark.createDataFrame(list(URL_RULES), RULES)).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_dot_segments_are_folded(spark):
    links = {"../q": "/q", "./q": "/a/q", "../../../q": "/q", "..": "/", ".": "/a/", "b/../../q?x=../y": "/q?x=../y", "/a/./b/../c": "/a/c", "...": "/a/..."}
    rows = spark.createDataFrame(list(links.items()), "href string, want string")
    got = rows.select("want", link_address(F.col("href"), F.lit("d.net"), F.lit("/a/p")).alias("got")).collect()
    assert [r.got for r in got] == ["x://d.net" + r.want for r in got]
    html = {1: '<link rel="canonical" href="../q">', 2: '<meta http-equiv="refresh" content="0; url=http://x.org/bad">', 3: None}
    urls = {1: "http://d.net/a/p", 2: "http://d.net/q", 3: "http://d.net/a/q"}
    pages = spark.createDataFrame([(i, urls[i], html[i], "", "", "") for i in urls], PAGES)
    rules = spark.createDataFrame([("x.org", "/bad", "block")], RULES)
    assert {r.page_id: r.verdict for r in filter_urls(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_broken_html_takes_linear_time(spark):
    html = ["<link " * 170_000, "<link rel=" + "rel=" * 250_000, "<meta content=" + " " * 1_000_000, '<link rel="canonical" href="http://x.org/bad">' * 1000]
    html += ["<meta http-equiv=refresh content=" + "0" * 1_000_000 + ">", '<link rel="canonical" href="' + "a/../" * 200_000 + '">']
    pages = spark.createDataFrame([(i, f"http://d{i}.net/", h, "", "", "") for i, h in enumerate(html)], PAGES)
    rules = spark.createDataFrame([("x.org", "/bad", "block")], RULES)
    start = time.perf_counter()
    assert {r.page_id for r in filter_urls(pages, rules).collect() if r.verdict == "block"} == {3}
    assert time.perf_counter() - start < 60


def test_longest_rule_ties_and_broken_rules(spark):
    rules = [("b.c", "/x", "block"), ("a.b.c", "", "block"), ("c", "/xy", "allow"), ("c", "/xy", "block"), (None, "/", "block"), ("c", None, "maybe"), ("C", "/", "block")]
    urls = ["http://a.b.c/xyz", "http://b.c/xyz", "http://z.c/xy", "http://c/", "http://c"]
    rows = spark.createDataFrame([(i, u, None, "", "", "") for i, u in enumerate(urls)], PAGES)
    found = {r.page_id: (r.rule, r.verdict) for r in filter_urls(rows, spark.createDataFrame(rules, RULES)).collect()}
    # five characters each for b.c/x and a.b.c: allow first, then the longer host
    assert found == {0: ("a.b.c", "block"), 1: ("b.c/x", "block"), 2: ("c/xy", "allow"), 3: ("c/", "block"), 4: (None, "allow")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAGES)
    assert filter_urls(none, spark.createDataFrame([], RULES)).collect() == []
    assert {r.verdict for r in filter_urls(pages(spark), spark.createDataFrame([], RULES)).collect()} == {"allow"}
