"""Rows (site, rule, pages) for rules.issues(extra=...): what robots.txt, llms.txt, sitemaps, probes, the link graph and
JSON-LD tell about a site. A rule that many pages break has a row for each page, so that no list grows with the site."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import html, validation
from auditloom.operators import graph, jsonld, robots
from auditloom.operators.rules import FEW_SAMEAS

# Fixed value
ABOUT_LINK = r"(?i)\(https?://[^)]*(about|bio|author|meet)[^)]*\)"
OK_STATUS = "status between 200 and 299"


def _rows(df: DataFrame, rule: str, url: str | None = None) -> DataFrame:
    pages = F.array(F.col(url)) if url else F.array().cast("array<string>")
    return df.select("site", F.lit(rule).alias("rule"), pages.alias("pages"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("int").alias("impact"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _is(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def robots_rows(files: DataFrame) -> DataFrame:
    """files: (site, ok, status, text) of each site's robots.txt. Where only some search bots are blocked, the issue is a
    warning of impact 3."""
    told = robots.bot_access(files).groupBy("site").agg(
        F.count_if((F.col("kind") == "search") & (F.col("access") == "blocked")).alias("search"),
        F.count_if(F.col("kind") == "search").alias("of"),
        F.count_if((F.col("kind") == "training") & (F.col("access") == "blocked")).alias("training"),
    )
    some = F.col("search") < F.col("of")
    blocked = told.where("search > 0").select("site", F.lit("ai_search_bot_blocked").alias("rule"), F.array().cast("array<string>").alias("pages"), F.when(some, "warning").alias("severity"), F.when(some, 3).alias("impact"))
    lost = files.where(~_is(F.col("ok")) & ~_is(F.col("status").isin(404, 410)))
    return _all(blocked, _rows(told.where("training > 0"), "ai_training_bot_blocked"), _rows(lost, "robots_unavailable"))


def llms_rows(files: DataFrame) -> DataFrame:
    """files: (site, ok, text) of each site's llms.txt, also where there is none."""
    there = _is(F.col("ok")) & (F.length(F.coalesce("text", F.lit(""))) >= 50)
    has = files.where(there)
    return _all(
        _rows(files.where(~there), "llms_txt_missing"),
        _rows(has.where(~F.col("text").rlike(ABOUT_LINK)), "llms_txt_no_about_link"),
        _rows(has.where(F.size(validation.llms_problems(F.col("text"))) > 0), "llms_txt_malformed"),
    )


def sitemap_rows(sitemaps: DataFrame, files: DataFrame, sited: DataFrame) -> DataFrame:
    """sitemaps: (site, ok, text) of each site, also where there is none; files: robots.txt as in robots_rows()."""
    there = _is(F.col("ok"))
    named = robots.sitemap_lines(files.where(_is(F.col("ok")))).select("site").distinct()
    listed = robots.sitemap_urls(sitemaps.where(there)).select("site", "url").distinct()
    broken = sited.where(~_is(F.expr(OK_STATUS))).join(listed, ["site", "url"], "left_semi")
    return _all(
        _rows(sitemaps.where(~there), "sitemap_missing"),
        _rows(sitemaps.where(there).join(named, "site", "left_anti"), "sitemap_not_in_robots"),
        _rows(broken, "sitemap_broken_urls", "url"),
    )


def bing_rows(files: DataFrame, sited: DataFrame) -> DataFrame:
    """files: (site, ok, text) of the verification file; a page that answered well may have the meta tag instead (bing_verification)."""
    marked = sited.where(OK_STATUS).where("bing_verification").select("site")
    filed = files.where(_is(F.col("ok")) & F.coalesce("text", F.lit("")).rlike("(?i)<user>")).select("site")
    return _rows(sited.select("site").distinct().join(marked.unionByName(filed).distinct(), "site", "left_anti"), "bing_verification_not_found")


def orphan_rows(sited: DataFrame, links: DataFrame, sitemap: DataFrame, sites: DataFrame) -> DataFrame:
    """Arguments as in graph.orphans(); pages that answered well only."""
    return _rows(graph.orphans(sited.where(OK_STATUS).select("site", "url"), links, sitemap, sites), "orphan_pages", "url")


def probe_rows(images: DataFrame, http: DataFrame) -> DataFrame:
    """images: (site, url, status) of probed images; http: (site, homepage, ok, redirects): the homepage's http address,
    whether it answered, and whether it led to https."""
    told = F.concat("url", F.lit(" (HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("0")), F.lit(")"))
    broken = images.where(~_is(F.expr(OK_STATUS))).select("site", told.alias("url")).distinct()
    open_http = http.where(F.startswith("homepage", F.lit("https://")) & _is(F.col("ok")) & ~_is(F.col("redirects")))
    return _all(_rows(broken, "schema_image_broken", "url"), _rows(open_http, "http_not_redirected"))


def person_rows(parsed: DataFrame) -> DataFrame:
    """parsed: (site, url, status, ld), ld from jsonld.with_nodes()."""
    people = jsonld.of_type(F.col("ld.nodes"), "Person")
    some = parsed.where(OK_STATUS).where(F.size(people) > 0).select("site", "url", people.alias("people"), jsonld.persons_thin(F.col("ld.nodes")).alias("thin"))
    links = some.select("site", F.explode_outer(jsonld.same_as(F.col("people"))).alias("link")).distinct().groupBy("site").agg(F.count("link").alias("n"))
    thin = some.groupBy("site").agg(F.bool_and("thin").alias("all_thin")).where("all_thin").select("site")
    return _all(_rows(links.where(F.col("n") < FEW_SAMEAS), "sameas_thin"), _rows(some.join(thin, "site", "left_semi"), "person_schema_thin", "url"))


def with_jsonld(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """facts with invalid_jsonld, books_incomplete, faq_mismatches and person_links of the page's JSON-LD, for by_site() and site_hits(), and ld itself, for
    bundle(). pages: (page_id, html), each page once."""
    nodes, shown = F.col("ld.nodes"), html.visible_text(html.without_raw(F.coalesce(F.col("html"), F.lit(""))))
    told = jsonld.with_nodes(pages.select("page_id", "html")).select(
        "page_id", F.col("ld.invalid").alias("invalid_jsonld"), jsonld.books_incomplete(nodes).alias("books_incomplete"), F.size(validation.faq_mismatch(jsonld.faq_entries(nodes), shown)).alias("faq_mismatches"),
        jsonld.same_as(jsonld.of_type(nodes, "Person")).alias("person_links"), "ld",
    )
    return facts.drop("invalid_jsonld", "books_incomplete", "faq_mismatches", "person_links", "ld").join(told, "page_id", "left")


def bundle(sited: DataFrame, pages: DataFrame, links: DataFrame, sites: DataFrame, files: dict[str, DataFrame]) -> DataFrame:
    """All rows that a site's bundle gives, for rules.issues(extra=...). sited: facts by site, whose ld is used if they have it; pages: (page_id, site, url, status, html);
    links: (site, src, dst); sites: (site, homepage, uncrawled). files: robots (site, ok, status, text), llms, sitemap and bing
    (site, ok, text), images (site, url, status) and http (site, homepage, ok, redirects); each has a row for a site, also where
    there is none, but images."""
    listed = robots.sitemap_urls(files["sitemap"].where(_is(F.col("ok")))).select("site", "url").distinct()
    return _all(
        robots_rows(files["robots"]),
        llms_rows(files["llms"]),
        bing_rows(files["bing"], sited),
        sitemap_rows(files["sitemap"], files["robots"], sited),
        orphan_rows(sited, links, listed, sites),
        probe_rows(files["images"], files["http"]),
        person_rows(sited if "ld" in sited.columns else jsonld.with_nodes(pages)),
    )
