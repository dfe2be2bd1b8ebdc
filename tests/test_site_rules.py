"""Rules and depths where a site is large, deep or known from more than its pages."""

from pyspark.sql import functions as F

from auditloom.operators import graph, jsonld, rules, site_rows

PAGE = """page_id long, url string, status int, title string, description string, hrefs array<string>, schema_types array<string>, og_present int, word_count int,
has_main boolean, semantic_count int, h1_count int, img_missing_alt int, canonical string, noindex boolean, mixed_content int, viewport boolean, lang string, app_shell boolean, script_count int"""


def pages(spark, rows):
    rest = (["Person", "Book"], 3, 500, True, 2, 1, 0, "", False, 0, True, "en", False, 0)
    return rules.by_site(spark.createDataFrame([(i, u, s, t, d, h, *rest) for i, u, s, t, d, h in rows], PAGE))


def test_equal_titles_and_shop_links(spark):
    rows = [
        (1, "https://a.com/", 200, "Same title here", "d one", ["https://www.amazon.com/x", None]),
        (2, "https://a.com/2", 200, " same TITLE here", "d two", ["https://goodreads.com/x"]),
        (3, "https://a.com/3", 404, "Other title here", "d one", ["https://bookbub.com/x"]),
        (4, "https://a.com/4", 200, "Other title here", "", None),
        (5, "https://a.com/5", 200, None, "", []),
        (6, "https://b.com/", 200, "Same title here", "d one", ["https://bookbub.com/x"]),
    ]
    sited = pages(spark, rows)
    hits = {(r.ord, r.rule) for r in rules.page_hits(sited).collect()}
    assert {o for o, r in hits if r == "title_duplicate"} == {1, 2}
    assert not {o for o, r in hits if r == "meta_description_duplicate"}
    assert {r.site for r in rules.site_hits(sited).collect() if r.rule == "retailer_links_thin"} == {"b.com"}


def test_no_buffer_of_a_whole_site(spark):
    sited = pages(spark, [(1, "https://a.com/", 200, "t", "d", ["https://goodreads.com/x"])])
    plan = rules.issue_pages(sited)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_set" not in plan


def test_depths_have_no_bound(spark):
    links = spark.createDataFrame([("s", f"/{i}", f"/{i + 1}") for i in range(103)], "site string, src string, dst string").coalesce(1)
    found = graph.depths(links, spark.createDataFrame([("s", "/0")], "site string, url string"))
    assert found.agg(F.max("depth"), F.count("*")).first() == (103, 104)


def test_rows_of_robots_sitemaps_probes_and_json_ld(spark):
    sited = pages(spark, [(1, "https://a.com/", 200, "t", "d", []), (2, "https://a.com/gone", 404, "t", "d", []), (3, "https://a.com/lost", 200, "t", "d", []), (4, "https://a.com/lost2", 200, "t", "d", [])])
    files = spark.createDataFrame([("a.com", True, 200, "User-agent: OAI-SearchBot\nDisallow: /\nUser-agent: GPTBot\nDisallow: /"), ("b.com", False, 503, None), ("c.com", False, 404, None)], "site string, ok boolean, status int, text string")
    llms = spark.createDataFrame([("a.com", True, "# T\n" + "plain words " * 9), ("b.com", False, None)], "site string, ok boolean, text string")
    urls = ["https://a.com/gone", "https://a.com/lost", "https://a.com/lost2", "https://a.com/"]
    maps = spark.createDataFrame([("a.com", True, "".join(f"<loc>{u}</loc>" for u in urls)), ("b.com", False, None)], "site string, ok boolean, text string")
    sitemap = spark.createDataFrame([("a.com", u) for u in urls], "site string, url string")
    links = spark.createDataFrame([("a.com", "https://a.com/", "https://a.com/x")], "site string, src string, dst string")
    sites = spark.createDataFrame([("a.com", "https://a.com/", 0)], "site string, homepage string, uncrawled int")
    images = spark.createDataFrame([("a.com", "i", 404), ("b.com", "j", 200)], "site string, url string, status int")
    http = spark.createDataFrame([("a.com", "https://a.com/", True, False), ("b.com", "https://b.com/", True, True)], "site string, homepage string, ok boolean, redirects boolean")
    body = '<script type="application/ld+json">{"@type":"Person","name":"J","sameAs":["https://x.com/j"]}</script><script type="application/ld+json">{bad</script>'
    raw = spark.createDataFrame([(1, "a.com", "https://a.com/", 200, body)], "page_id long, site string, url string, status int, html string")
    parts = [site_rows.robots_rows(files), site_rows.llms_rows(llms), site_rows.sitemap_rows(maps, files, sited), site_rows.orphan_rows(sited, links, sitemap, sites), site_rows.probe_rows(images, http), site_rows.person_rows(jsonld.with_nodes(raw))]
    extra = site_rows._all(*parts).cache()
    got = {}
    for r in extra.collect():
        got.setdefault((r.site, r.rule), []).extend(r.pages)
    a = {"ai_search_bot_blocked", "ai_training_bot_blocked", "llms_txt_no_about_link", "llms_txt_malformed", "sitemap_not_in_robots", "sitemap_broken_urls", "orphan_pages", "schema_image_broken", "http_not_redirected", "sameas_thin", "person_schema_thin"}
    assert set(got) == {("a.com", r) for r in a} | {("b.com", r) for r in ("robots_unavailable", "llms_txt_missing", "sitemap_missing")}
    assert sorted(got["a.com", "orphan_pages"]) == ["https://a.com/lost", "https://a.com/lost2"] and got["a.com", "sitemap_broken_urls"] == ["https://a.com/gone"]
    found = {r.rule: r for r in rules.issues(sited, extra).where("site = 'a.com'").collect()}
    assert found["orphan_pages"].n_pages == 2 and (found["ai_search_bot_blocked"].severity, found["ai_search_bot_blocked"].impact) == ("warning", 3)
    facts = site_rows.with_jsonld(sited.drop("site", "ord", "invalid_jsonld", "books_incomplete", "faq_mismatches"), raw)
    assert [r.ord for r in rules.page_hits(rules.by_site(facts)).collect() if r.rule == "jsonld_invalid"] == [1]
