"""Golden cases of single operators."""

from pyspark.sql import functions as F

from auditloom.functions import html, scoring, urls, validation
from auditloom.operators import artifacts, facts, graph, jsonld, reports, rules
from auditloom.plans import sites, texts
from auditloom.sources import lists


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_canonical(spark):
    got = {r.id: r.correct for r in sites.canonical_check(spark, "").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: True}


def test_links(spark):
    got = {r.id: r.link for r in sites.link_resolution(spark, "").collect()}
    assert got == {1: "https://www.author.com/books/one", 2: "https://author.com/about", 3: None, 4: None, 5: None, 6: "https://author.com/books/two", 7: "https://author.com/", 8: None}


def test_site_urls(spark):
    got = {r.id: r.site for r in texts.site_url(spark, "").collect()}
    assert got == {1: "https://example.com/books", 2: None, 3: None, 4: "http://example.com/", 5: None, 6: None}


def test_ipv6(spark):
    assert {r.id: r.private for r in texts.ip6_private(spark, "").collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: True}


def test_json_ld(spark):
    got = {r.page_id: r for r in sites.jsonld_summary(spark, "").collect()}
    assert (got[1].n_nodes, got[1].n_same_as, got[1].persons_thin, got[1].books_incomplete) == (3, 2, False, False)
    assert (got[2].n_nodes, got[2].invalid, got[2].images) == (2, 1, "http://b.com/l.png")
    assert (got[3].n_nodes, got[3].invalid) == (0, 0)


def test_faq(spark):
    got = {r.page_id: (r.n_entries, r.missing) for r in sites.faq_mismatch(spark, "").collect()}
    assert got[4] == (2, "Hidden question?") and got[3] == (0, "")


def test_faq_quotes(spark):
    entries = F.array(F.struct(F.lit("What’s  it?").alias("question"), F.lit("“A”").alias("answer")))
    assert one(spark, validation.faq_mismatch(entries, F.lit("what's it? \"a\""))) == []


def test_word_count(spark):
    page = "<body><script>" + "word " * 500 + "</script><p>Two words</p><!-- not these --></body>"
    assert one(spark, html.word_count(html.visible_text(html.without_raw(F.lit(page))))) == 2
    assert one(spark, html.word_count(html.visible_text(html.without_raw(F.lit("<body><li>a</li><li>b</li></body>"))))) == 1


def test_full_score(spark):
    page = (
        '<html lang="en"><head><title>T</title><link rel="canonical" href="https://a.com/"><meta property="og:title" content="t"><meta property="og:description" content="d">'
        '<meta property="og:image" content="i"><script type="application/ld+json">[{"@type":"Person"},{"@type":"Book"}]</script></head><body><h1>A</h1><h2>B</h2>'
        '<a href="https://www.goodreads.com/x">g</a> ' + "word " * 310 + "</body></html>"
    )
    df = facts.page_facts(spark.createDataFrame([(1, "https://a.com/", page)], "page_id long, url string, html string"))
    row = facts.scan(df, F.lit(4), F.lit(True), F.lit(True)).first()
    assert (row.score, row.grade) == (100, "A (Strong Foundations)")


def test_spoofed_hosts(spark):
    def points(h):
        return one(spark, facts.entity_link_points(F.array(F.lit(h))))

    assert [points(h) for h in ("amazon.com.evil.example", "www.amazon.co.uk", "amzn.to", "x.amzn.to")] == [0, 10, 10, 0]


def test_quadrants(spark):
    got = [one(spark, scoring.quadrant(F.lit(i), F.lit(e))) for i, e in ((5, 1), (4, 4), (2, 1), (2, 4))]
    assert got == ["Quick win", "Major project", "Fill-in", "Deprioritize"]
    assert one(spark, scoring.priority(F.lit(3), F.lit("warning"), F.lit(1))) == 60
    assert sum(scoring.WEIGHTS.values()) == 100 and len(rules.RULES) == 46


def test_guard(spark):
    assert one(spark, validation.guarded(F.lit("Bots are blocked."), F.lit("fine"), F.lit(False))) == "fine"
    assert one(spark, validation.guarded(F.lit("Bots are blocked."), F.lit("fine"), F.lit(True))) == "Bots are blocked."


def test_small_functions(spark):
    assert one(spark, validation.comma_list(F.lit(" a, ,b,"))) == ["a", "b"]
    assert one(spark, validation.outer_json(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'
    assert one(spark, validation.outer_json(F.lit("{bad}"))) is None
    assert one(spark, validation.markdown_link(F.lit("[A]"), F.lit("u"), F.lit("d"))) == "- [A](u): d"
    assert one(spark, validation.fill_template(F.lit("Hi [NAME], [X]"), {"NAME": F.lit("Ann")})) == "Hi Ann, [X]"
    assert one(spark, reports.capped_list(F.array(*map(F.lit, "abc")), 2)) == ["a", "b", "…and 1 more"]
    assert one(spark, urls.with_scheme(F.lit("ftp://x"), False)) == "ftp://x" and one(spark, urls.with_scheme(F.lit("ftp://x"), True)) == "https://ftp://x"
    assert one(spark, validation.postal_address(F.lit("1 Main St, Town"))) and not one(spark, validation.postal_address(F.lit("Main, Town")))


def test_crawl_order(spark):
    df = spark.createDataFrame([("s", "/c", None, 0), ("s", "/a", 0, 1), ("s", "/b", 1, 2)], "site string, url string, depth int, ord int")
    assert [r.url for r in graph.crawl_order(df, 2).orderBy("place").collect()] == ["/a", "/b"]


def test_rules_with_responses(spark):
    rows = [(1, "http://s.com/", "<html></html>", 200), (2, "http://s.com/x", "", 404), (3, "http://s.com/y", "", 0)]
    sited = rules.by_site(facts.page_facts(spark.createDataFrame(rows, "page_id long, url string, html string, status int")))
    extra = spark.createDataFrame([("s.com", "sitemap_missing", [])], "site string, rule string, pages array<string>")
    found = {r.rule: r for r in rules.ranked(rules.issues(sited, extra)).collect()}
    assert {"broken_internal_links", "server_errors", "title_missing", "h1_missing", "lang_missing", "not_https", "sitemap_missing"} <= set(found)
    pages = {r.rule: r.url for r in rules.issue_pages(sited, extra).collect() if r.rule in ("broken_internal_links", "server_errors")}
    assert pages == {"broken_internal_links": "http://s.com/x", "server_errors": "http://s.com/y"}
    assert found["sitemap_missing"].n_pages == 0 and found["server_errors"].n_pages == 1
    ordered = sorted(found.values(), key=lambda r: r["rank"])
    assert [r.priority for r in ordered] == sorted((r.priority for r in ordered), reverse=True)


def test_csv_round(spark, tmp_path):
    path = str(tmp_path / "out")
    lists.write_csv(spark.createDataFrame([("a,b", 1)], "x string, y int"), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['"a,b",1', "x,y"]


def test_html_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text("<p>é</p>")
    (tmp_path / "b.txt").write_text("no")
    assert [r.html for r in lists.html_files(spark, str(tmp_path)).collect()] == ["<p>é</p>"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    sited = rules.by_site(facts.page_facts(empty))
    assert rules.issues(sited).count() == 0
    assert jsonld.with_nodes(empty).count() == 0


def test_nulls(spark):
    row = facts.page_facts(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")).first()
    assert (row.title, row.word_count, row.h1_count) == ("", 0, 0)


def test_artifacts(spark):
    assert one(spark, artifacts.guess_name(F.lit(None).cast("string"), F.lit(" "), F.lit("Jane Author — Official"))) == "Jane Author"
    assert one(spark, artifacts.robots_txt(F.lit("https://a.com"))).endswith("Sitemap: https://a.com/sitemap.xml")
    assert '"@type":"Person"' in one(spark, artifacts.person_json(F.lit("https://a.com"), F.lit("J"), F.lit(""), F.array(F.lit("https://g.com"))))
    assert '"name":"B"' in one(spark, artifacts.book_json(F.lit("https://a.com"), F.lit("B")))
    assert one(spark, artifacts.model_source(F.lit("T"), F.lit(""), F.array(F.lit("b")), F.lit("x" * 9000))).startswith("Title: T\n\nBooks (structured data):\nb\n\nPage text:\nx")
    files = spark.createDataFrame([("index.html",), ("a.html",), ("b/index.html",)], "file string")
    asked = spark.createDataFrame([("/",), ("/a",), ("/b/",), ("/c",)], "path string")
    assert [r.path for r in artifacts.sitemap_files(asked, files).collect()] == ["/c"]


def test_overview_caps(spark):
    rows = [(i, f"https://s.com/{'books' if i else ''}/{i}", f"<title>Title number {i}</title>") for i in range(20)] + [(30, "https://s.com/about", ""), (31, "https://s.com/privacy", "")]
    sited = rules.by_site(facts.page_facts(spark.createDataFrame(rows, "page_id long, url string, html string")))
    names = spark.createDataFrame([("s.com", "Jane", "", "https://s.com/")], "site string, name string, description string, home string")
    text = artifacts.overview(sited, names).first().text
    assert text.count("/books/") == 15 and "## About" in text and "privacy" not in text and text.startswith("# Jane\n\n> The official pages of Jane.")


def test_report_blocks(spark):
    df = spark.createDataFrame([("s", 1, "a<b", "error", "Quick win", 2)], "site string, rank int, rule string, severity string, quadrant string, n_pages long")
    assert "a&lt;b" in artifacts.report_html(df).first().html
