"""Crawls with seeds of unknown depth, nested sitemaps, and rules that are looked up by their beginning."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import graph, reports, robots


def plainly(links, home, seeds, most, room):
    """A crawl of one site, a page at a time: [(url, depth)] in order, and how many found pages are left."""
    outs = {}
    for src, dst, pos in sorted(links, key=lambda r: r[2]):
        outs.setdefault(src, []).append((pos, dst))
    found = {home: 0} | {u: None for u in dict.fromkeys(seeds) if u != home}
    visited = []
    while len(visited) < most:
        due = [u for u in found if u not in visited]
        if not due:
            break
        url = min(due, key=lambda u: (found[u] is None, found[u] or 0))
        visited.append(url)
        for _, dst in sorted(outs.get(url, [])):
            if dst not in found and len(found) < room:
                found[dst] = None if found[url] is None else found[url] + 1
    depth = dict(found)
    for url in visited:
        above = [depth[s] for s in visited if depth[s] is not None and any(d == url for _, d in outs.get(s, []))]
        if depth[url] is None and above:
            depth[url] = min(above) + 1
    return [(u, depth[u]) for u in visited], len(found) - len(visited)


@pytest.mark.parametrize(("most", "room"), [(30, None), (6, 9), (12, 14)])
def test_crawl_by_pages(spark, most, room):
    r = np.random.default_rng(most)
    sites, links, seeds = [f"s{i}" for i in range(12)], [], []
    for i, s in enumerate(sites):
        n = int(r.integers(3, 40))
        links += [(s, f"/{r.integers(0, n)}", f"/{r.integers(0, n)}", k) for k in range(int(r.integers(0, 3 * n)))]
        seeds += [(s, f"/{u}", k) for k, u in enumerate(r.permutation(n)[: i % 5])]
    frames = spark.createDataFrame(links, "site string, src string, dst string, pos int"), spark.createDataFrame([(s, "/0") for s in sites], "site string, url string"), spark.createDataFrame(seeds, "site string, url string, pos int")
    got = graph.crawl(*frames, most=most, found_most=room).collect()
    for s in sites:
        rows = sorted((x for x in got if x.site == s), key=lambda x: x.place)
        expected, left = plainly([x[1:] for x in links if x[0] == s], "/0", [u for t, u, _ in seeds if t == s], most, room or 3 * most)
        assert [(x.url, x.depth) for x in rows] == expected and {x.uncrawled for x in rows} == {left}
        assert [x.place for x in rows] == list(range(1, len(rows) + 1))


def test_unknown_depth_is_passed_on(spark):
    links = spark.createDataFrame([("s", "/", "/a", 1), ("s", "/seed", "/below", 1), ("s", "/below", "/seed", 1), ("s", "/a", "/told", 1), (None, "/", "/x", 1), ("s", "/", None, 2)], "site string, src string, dst string, pos int")
    homes = spark.createDataFrame([("s", "/"), ("alone", "/")], "site string, url string")
    seeds = spark.createDataFrame([("s", "/seed", 1), ("s", "/told", 2), ("s", "/", 3), ("unknown", "/x", 1)], "site string, url string, pos int")
    got = {(r.site, r.url): r.depth for r in graph.crawl(links, homes, seeds).collect()}
    assert got == {("s", "/"): 0, ("s", "/a"): 1, ("s", "/told"): 2, ("s", "/seed"): None, ("s", "/below"): None, ("alone", "/"): 0}
    assert graph.crawl(links.limit(0), homes.limit(0), seeds.limit(0)).count() == 0


def test_sitemaps_in_sitemaps(spark):
    def index(*urls):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"

    def pages(*urls):
        return "<urlset>" + "".join(f"<url><loc> {u} </loc></url>" for u in urls) + "</urlset>"

    files = [
        ("top", True, index("one", "gone", "nested", "one", "failed", "sixth")),
        ("one", True, pages("p1", "p2", "p1")), ("nested", True, index("deep", "top", "nested")), ("deep", True, pages("p3", "p2", "p?a=1&amp;b=2")),
        ("failed", False, pages("no")), ("sixth", True, pages("six")), ("flat", True, pages("q")), ("text", True, "nothing"), ("null", True, None),
    ]
    roots = [("s", "top"), ("f", "flat"), ("g", "missing"), ("t", "text"), ("n", "null"), ("z", None)]
    frames = spark.createDataFrame(roots, "site string, url string"), spark.createDataFrame(files, "url string, ok boolean, text string")
    got = sorted((r.site, r.pos, r.url) for r in robots.expand_sitemaps(*frames).collect())
    assert got == [("f", 1, "q"), ("s", 1, "p1"), ("s", 2, "p2"), ("s", 3, "p3"), ("s", 4, "p?a=1&b=2")]
    assert {r.url for r in robots.expand_sitemaps(*frames, most=6).where("site = 's'").collect()} >= {"six"}


def test_presence_and_access_of_the_scanned_path(spark):
    rules = "User-agent: *\nDisallow: /find?q=\n\nUser-agent: Googlebot\nAllow: /"
    files = spark.createDataFrame([("a", True, 200, rules), ("b", False, 404, None), ("c", False, 503, rules), ("d", True, 200, "User-agent: *\nDisallow: /\nSitemap: https://d/x")], "site string, ok boolean, status int, text string")
    scans = spark.createDataFrame([("a", "/find?q=1"), ("a", "/find"), ("b", "/"), ("c", "/"), ("d", "/"), ("e", "/")], "site string, path string")
    got = {(r.site, r.path): (r.allowed, r.known, r.status) for r in robots.scan_access(files, scans).collect()}
    assert got == {("a", "/find?q=1"): (1, True, "partially_blocked"), ("a", "/find"): (4, True, "unrestricted"), ("b", "/"): (4, True, "unrestricted"), ("c", "/"): (0, False, "unknown"), ("d", "/"): (0, True, "blocked"), ("e", "/"): (0, False, "unknown")}
    maps = spark.createDataFrame([("a", True, "<URLSET x>"), ("b", True, "<html>"), ("c", False, "<urlset>")], "site string, ok boolean, text string")
    assert {r.site: r.has_sitemap for r in robots.has_sitemap(files, maps).collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_access_by_trying_every_rule(spark):
    r = np.random.default_rng(1)
    parts = ["/", "a", "b", "*", "$", "?", "."]
    rules = [("s", r.choice(["*", "x"]), i, r.choice(["allow", "disallow"]), "/" + "".join(r.choice(parts, r.integers(0, 5)))) for i in range(120)]
    asked = [("s", r.choice(["x", "y"]), "/" + "".join(r.choice(["/", "a", "b", "?", "."], r.integers(0, 7)))) for _ in range(80)]
    got = {(x.agent, x.path): x.verdict for x in robots.access(spark.createDataFrame(rules, "site string, agent string, pos int, action string, path string"), spark.createDataFrame(asked, "site string, agent string, path string")).collect()}
    for _, agent, path in asked:
        best = None
        for _, who, _, action, rule in rules:
            if who == (agent if agent == "x" else "*"):
                end = rule.endswith("$")
                pattern = ".*".join(map(re.escape, (rule[:-1] if end else rule).split("*")))
                if re.match(pattern + (r"\Z" if end else ""), path):
                    mark = (len(re.sub(r"\$$", "", rule).replace("*", "")), action == "allow")
                    best = max(best, mark) if best else mark
        assert got[agent, path] == ("blocked" if best and not best[1] else "allowed")
    assert len(got) == len({(a, p) for _, a, p in asked})


def test_many_rules_meet_few_paths(spark):
    """A site of 100,000 rules and as many paths: each path meets the rules that it begins with, not all."""
    n = 100_000
    rules = spark.range(n).select(F.lit("s").alias("site"), F.lit("*").alias("agent"), F.col("id").cast("int").alias("pos"), F.lit("disallow").alias("action"), F.concat(F.lit("/p"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("/*x")).alias("path"))
    asked = spark.range(n).select(F.lit("s").alias("site"), F.lit("bot").alias("agent"), F.concat(F.lit("/p"), F.lpad(F.col("id").cast("string"), 6, "0"), F.when(F.col("id") % 2 == 0, "/ax").otherwise("/ay")).alias("path"))
    told = robots.access(rules, asked).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in told} == {"blocked": n // 2, "allowed": n // 2}


def test_rewrites(spark):
    rules = [(1, "/old/*", "/new/:splat", 301), (2, "/home", "/", 302), (3, "/old/a/*", "/never", 301), (4, "*.php", "/php", 410), (5, None, "/", 1), (6, "/a.b", "/dot", 303)]
    paths = [("/old/a/b",), ("/x",), ("/home",), ("/home",), ("/q.php",), ("/aXb",), ("/a.b",), (None,)]
    got = reports.rewrite(spark.createDataFrame(paths, "path string"), spark.createDataFrame(rules, "ord int, pattern string, target string, status int")).collect()
    told = {(r.path, r.target, r.status) for r in got}
    assert told == {("/old/a/b", "/new/a/b", 301), ("/x", "/x", 200), ("/home", "/", 302), ("/q.php", "/php", 410), ("/aXb", "/aXb", 200), ("/a.b", "/dot", 303), (None, None, 200)} and len(got) == 8
    assert {r.status for r in reports.rewrite(spark.createDataFrame(paths, "path string"), spark.createDataFrame([], "ord int, pattern string, target string, status int")).collect()} == {200}
