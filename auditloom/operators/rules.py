"""The table of prioritised rules, its evaluation in one pass over the facts, and scores of sites."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.checkpoints import written
from auditloom.functions import scoring, urls

# Id, category, severity, impact, effort, in the order that breaks ties of priority
RULES = (
    ("ai_search_bot_blocked", "AI access", "error", 5, 1),
    ("ai_training_bot_blocked", "Publisher controls", "notice", 0, 1),
    ("robots_unavailable", "Crawlability", "warning", 3, 1),
    ("llms_txt_missing", "Optional metadata", "notice", 0, 1),
    ("llms_txt_no_about_link", "Optional metadata", "notice", 0, 1),
    ("llms_txt_malformed", "Optional metadata", "notice", 0, 1),
    ("bing_verification_not_found", "Search tooling", "notice", 1, 1),
    ("person_schema_missing", "Entity & schema", "error", 5, 2),
    ("sameas_thin", "Entity & schema", "warning", 4, 1),
    ("person_schema_thin", "Entity & schema", "notice", 2, 1),
    ("schema_image_broken", "Entity & schema", "warning", 3, 1),
    ("faq_schema_mismatch", "Entity & schema", "warning", 3, 1),
    ("book_schema_missing", "Entity & schema", "error", 4, 2),
    ("book_schema_incomplete", "Entity & schema", "warning", 3, 2),
    ("jsonld_invalid", "Entity & schema", "error", 4, 1),
    ("retailer_links_thin", "Entity & schema", "warning", 3, 1),
    ("open_graph_missing", "Entity & schema", "notice", 2, 1),
    ("thin_content", "Content", "warning", 3, 3),
    ("content_too_long", "Content", "notice", 2, 3),
    ("low_semantic_html", "Content", "notice", 2, 3),
    ("stale_last_modified", "Content", "notice", 2, 2),
    ("about_page_missing", "Content", "warning", 3, 2),
    ("title_missing", "On-page", "error", 4, 1),
    ("title_duplicate", "On-page", "warning", 3, 1),
    ("title_length", "On-page", "notice", 1, 1),
    ("meta_description_missing", "On-page", "warning", 3, 1),
    ("meta_description_duplicate", "On-page", "warning", 2, 1),
    ("h1_missing", "On-page", "warning", 3, 1),
    ("h1_multiple", "On-page", "notice", 2, 1),
    ("img_alt_missing", "On-page", "warning", 2, 2),
    ("canonical_offsite", "On-page", "error", 4, 1),
    ("canonical_missing", "On-page", "notice", 2, 1),
    ("noindex", "Crawlability", "error", 5, 1),
    ("broken_internal_links", "Crawlability", "error", 4, 2),
    ("server_errors", "Crawlability", "error", 5, 3),
    ("deep_pages", "Crawlability", "notice", 2, 2),
    ("orphan_pages", "Crawlability", "warning", 2, 2),
    ("sitemap_missing", "Crawlability", "warning", 3, 1),
    ("sitemap_not_in_robots", "Crawlability", "notice", 1, 1),
    ("sitemap_broken_urls", "Crawlability", "warning", 3, 2),
    ("not_https", "Technical", "error", 4, 3),
    ("http_not_redirected", "Technical", "warning", 3, 2),
    ("mixed_content", "Technical", "warning", 3, 2),
    ("viewport_missing", "Technical", "warning", 3, 1),
    ("lang_missing", "Technical", "notice", 1, 1),
    ("js_rendered_shell", "Technical", "error", 5, 4),
)
UTILITY_PATH = r"(?i)^/(404|500|privacy|terms|cookies?|refund|legal|disclaimer)(\.html)?/?$|-policy/?$"
READINESS = ("AI access", "Entity & schema", "Content")
STALE_DAYS, DEEP, FEW_SAMEAS, FEW_SHOPS = 365, 3, 3, 2


def by_site(facts: DataFrame) -> DataFrame:
    """Facts with site (the host) and ord (the page's place in its site: its id); the first page is the homepage. Columns
    that the capture lacks get the value of a page fetched without trouble."""
    defaults = {
        "status": F.lit(200),
        "last_modified": F.lit(None).cast("timestamp"),
        "depth": F.lit(None).cast("int"),
        "invalid_jsonld": F.lit(0),
        "books_incomplete": F.lit(False),
        "faq_mismatches": F.lit(0),
    }
    filled = facts.withColumns({c: v for c, v in defaults.items() if c not in facts.columns})
    return filled.withColumn("site", urls.host(F.col("url"))).withColumn("ord", F.col("page_id"))


def duplicates(facts: DataFrame, value: str) -> DataFrame:
    """Pages whose trimmed value, letters' size aside, occurs more than once in their site; blanks don't count."""
    v = F.lower(F.trim(F.col(value)))
    counted = facts.where(v != "").groupBy("site", v.alias("_v")).agg(F.count("*").alias("_n")).where("_n > 1")
    return facts.withColumn("_v", v).join(counted, ["site", "_v"]).drop("_v", "_n")


def page_rules(now: Column) -> dict[str, tuple[str, Column]]:
    """Rule, set of pages that it looks at (ok, content or all), and what it looks for."""
    c = F.col
    return {
        "faq_schema_mismatch": ("ok", c("faq_mismatches") > 0),
        "book_schema_incomplete": ("ok", c("books_incomplete")),
        "jsonld_invalid": ("ok", c("invalid_jsonld") > 0),
        "open_graph_missing": ("content", c("og_present") < 3),
        "thin_content": ("content", c("word_count") < scoring.THIN_WORDS),
        "content_too_long": ("ok", c("word_count") > scoring.LONG_WORDS),
        "low_semantic_html": ("content", ~c("has_main") & (c("semantic_count") < 2)),
        "stale_last_modified": ("ok", c("last_modified") < now - F.expr(f"INTERVAL {STALE_DAYS} DAYS")),
        "title_missing": ("ok", c("title") == ""),
        "title_duplicate": ("ok", c("_titles") > 1),
        "title_length": ("ok", (c("title") != "") & ~F.length("title").between(10, 70)),
        "meta_description_missing": ("ok", c("description") == ""),
        "meta_description_duplicate": ("ok", c("_descriptions") > 1),
        "h1_missing": ("ok", c("h1_count") == 0),
        "h1_multiple": ("ok", c("h1_count") > 1),
        "img_alt_missing": ("ok", c("img_missing_alt") > 0),
        "canonical_offsite": ("ok", (c("canonical") != "") & ~urls.canonical_correct(c("canonical"), c("url"))),
        "canonical_missing": ("ok", c("canonical") == ""),
        "noindex": ("content", c("noindex")),
        "broken_internal_links": ("all", c("status").between(400, 499)),
        "server_errors": ("all", (c("status") >= 500) | (c("status") == 0)),
        "deep_pages": ("ok", c("depth") > DEEP),
        "mixed_content": ("ok", c("mixed_content") > 0),
        "viewport_missing": ("ok", ~c("viewport")),
        "lang_missing": ("ok", c("lang") == ""),
        "js_rendered_shell": ("ok", (c("word_count") < 50) & (c("app_shell") | (c("script_count") >= 5))),
    }


def page_hits(sited: DataFrame, now: Column | None = None) -> DataFrame:
    """(site, ord, url, rule): one pass; the rules that a page breaks are filtered from an array and exploded."""
    ok = F.col("status").between(200, 299)
    sets = {"ok": ok, "content": ok & ~urls.path(F.col("url")).rlike(UTILITY_PATH), "all": F.lit(True)}
    # equal values are counted by an aggregate, which combines before the shuffle, and joined back; blanks don't count
    values = {"_titles": F.lower(F.trim("title")), "_descriptions": F.lower(F.trim("description"))}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), v.alias("v")) for name, v in values.items()))).alias("x")
    counted = sited.where(ok).select("site", each).select("site", "x.*").where("v <> ''").groupBy("site", "name", "v").agg(F.count("*").alias("n")).where("n > 1")
    with_counts = sited
    for name, v in values.items():
        some = counted.where(F.col("name") == name).select(F.col("site").alias("_site"), F.col("v").alias("_v"), F.col("n").alias(name))
        with_counts = with_counts.withColumn("_value", v)
        with_counts = with_counts.join(some, F.col("site").eqNullSafe(F.col("_site")) & (F.col("_value") == F.col("_v")), "left").drop("_site", "_v", "_value")
    tests = page_rules(F.current_timestamp() if now is None else now)
    hit = F.filter(F.array(*(F.when(sets[on] & test, F.lit(rule)) for rule, (on, test) in tests.items())), lambda r: r.isNotNull())
    return with_counts.select("site", "ord", "url", F.explode(hit).alias("rule"))


def site_hits(sited: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(site, rule, pages): rules about a site as a whole. extra: (site, rule, pages) of rules that need robots.txt,
    sitemaps, probes or the link graph (site_rows.py); it may have several rows of a site and rule, each with other pages."""
    ok = F.col("status").between(200, 299)

    def ever(test: Column) -> Column:
        return F.coalesce(F.bool_or(ok & test), F.lit(False))

    about = F.coalesce(F.bool_or(urls.path(F.col("url")).rlike("(?i)/(about|bio|author|meet)")), F.lit(False))
    hosts = F.transform("hrefs", lambda h: urls.host(urls.resolve(h, F.col("url"))))

    def linked(pattern: str) -> Column:
        told = F.exists(hosts, lambda h: h.rlike(pattern))
        if "person_links" in sited.columns:  # what Person nodes name counts as well
            told = told | F.coalesce(F.exists("person_links", lambda u: u.rlike("(?i)" + pattern)), F.lit(False))
        return F.when(ever(told), 1).otherwise(0)

    shops = linked(r"amazon\.[a-z.]+|amzn\.to") + linked(r"goodreads\.com") + linked(r"bookbub\.com")
    home = F.min_by("url", "ord")
    site = sited.groupBy("site").agg(
        home.alias("home"),
        ever(F.array_contains("schema_types", "Person")).alias("person"),
        ever(F.array_contains("schema_types", "Book") | F.array_contains("schema_types", "BookSeries")).alias("book"),
        about.alias("about"),
        shops.alias("shops"),
    )
    none = F.array().cast("array<string>")
    rows = F.array(
        F.when(~F.col("person"), F.struct(F.lit("person_schema_missing").alias("rule"), F.array("home").alias("pages"))),
        F.when(~F.col("book"), F.struct(F.lit("book_schema_missing").alias("rule"), none.alias("pages"))),
        F.when(F.col("shops") < FEW_SHOPS, F.struct(F.lit("retailer_links_thin").alias("rule"), none.alias("pages"))),
        F.when(~F.col("about"), F.struct(F.lit("about_page_missing").alias("rule"), none.alias("pages"))),
        F.when(urls.scheme(F.col("home")) != "https", F.struct(F.lit("not_https").alias("rule"), none.alias("pages"))),
    )
    found = site.select("site", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("site", "r.*")
    return found.unionByName(extra.select("site", "rule", "pages")) if extra is not None else found


def hits(sited: DataFrame, extra: DataFrame | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """page_hits() and site_hits(), written once for issues() and issue_pages() of the same facts."""
    return written(page_hits(sited, now), "page-hits"), written(site_hits(sited, extra), "site-hits")


def issue_pages(sited: DataFrame, extra: DataFrame | None = None, now: Column | None = None, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(site, rule, ord, url): the pages of every issue, one a row; ord is null where a rule about a site names a page. found: hits()
    of the same facts, where they are at hand."""
    on_pages, on_sites = found or (page_hits(sited, now), site_hits(sited, extra))
    named = on_sites.select("site", "rule", F.lit(None).cast("bigint").alias("ord"), F.explode("pages").alias("url"))
    return on_pages.select("site", "rule", F.col("ord").cast("bigint").alias("ord"), "url").unionByName(named)


def issues(sited: DataFrame, extra: DataFrame | None = None, now: Column | None = None, overrides: dict | None = None, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(site, rule_ord, rule, category, severity, impact, effort, priority, quadrant, n_pages): every broken rule of every
    site. Which pages break it is a table of its own, issue_pages(), so that a site's size doesn't matter. overrides:
    category, severity, impact and effort of rules that depend on how far they are broken. found: hits() of the same facts, where
    they are at hand."""
    spark = sited.sparkSession
    on_pages, on_sites = found or (page_hits(sited, now), site_hits(sited, extra))
    counted = on_pages.groupBy("site", "rule").agg(F.count("*").alias("n_pages"))
    wide = on_sites.groupBy("site", "rule").agg(F.sum(F.size("pages")).alias("n_pages"))
    rows = [(i, r[0], *(overrides or {}).get(r[0], r[1:])) for i, r in enumerate(RULES, 1)]
    dim = spark.createDataFrame(rows, "rule_ord int, rule string, category string, severity string, impact int, effort int")
    broken = counted.unionByName(wide).join(F.broadcast(dim), "rule")  # 46 fixed rows
    if extra is not None and {"severity", "impact"} <= set(extra.columns):  # where a site's own facts decide
        own = extra.where(F.col("severity").isNotNull()).select("site", "rule", F.col("severity").alias("_severity"), F.col("impact").alias("_impact")).distinct()
        broken = broken.join(own, ["site", "rule"], "left").withColumns({"severity": F.coalesce("_severity", "severity"), "impact": F.coalesce("_impact", "impact")}).drop("_severity", "_impact")
    return broken.withColumn("priority", scoring.priority(F.col("impact"), F.col("severity"), F.col("effort"))).withColumn("quadrant", scoring.quadrant(F.col("impact"), F.col("effort")))


def ranked(found: DataFrame) -> DataFrame:
    weight = F.create_map(*(F.lit(x) for kv in scoring.SEVERITY_WEIGHTS.items() for x in kv))
    order = W.partitionBy("site").orderBy(F.desc("priority"), F.desc(F.element_at(weight, F.col("severity"))), "rule_ord")
    return found.withColumn("rank", F.row_number().over(order))


def site_scores(found: DataFrame, pages: DataFrame, sited: DataFrame) -> DataFrame:
    """(site, pages, errors, warnings, notices, site_health, ai_readiness) from issues(), issue_pages() and the facts."""
    weight = F.create_map(*(F.lit(x) for kv in scoring.SEVERITY_WEIGHTS.items() for x in kv))
    error = F.col("severity") == "error"
    errors = [r[0] for r in RULES if r[2] == "error"]
    counts = {f"{s}s": F.count_if(F.col("severity") == s) for s in scoring.SEVERITY_WEIGHTS}
    touched = pages.where(F.col("rule").isin(errors)).select("site", F.substring_index("url", " ", 1).alias("url")).distinct().groupBy("site").agg(F.count("*").alias("_touched"))
    ready = F.col("category").isin(*READINESS) | F.col("rule").isin("js_rendered_shell", "noindex")
    told = found.groupBy("site").agg(
        *(v.alias(k) for k, v in counts.items()),
        F.count_if(error & (F.col("n_pages") == 0)).alias("_wide"),
        F.sum(F.when(ready, F.col("impact") * F.element_at(weight, F.col("severity"))).otherwise(0)).alias("_penalty"),
    )
    sizes = sited.groupBy("site").agg(F.count("*").alias("pages"))
    joined = sizes.join(told, "site", "left").join(touched, "site", "left").na.fill(0)
    health = F.round(100 * (F.col("pages") - F.col("_touched")) / F.col("pages")) - 10 * F.col("_wide")
    return joined.select("site", "pages", *counts, F.greatest(F.lit(0), health).cast("int").alias("site_health"), F.greatest(F.lit(0), 100 - F.col("_penalty")).cast("int").alias("ai_readiness"))


def quadrant_counts(found: DataFrame) -> DataFrame:
    """All four quadrants, also those without an issue."""
    four = found.sparkSession.createDataFrame([(x,) for x in ("Quick win", "Major project", "Fill-in", "Deprioritize")], "quadrant string")
    return four.join(found.groupBy("quadrant").agg(F.count("*").alias("n")), "quadrant", "left").select("quadrant", F.coalesce("n", F.lit(0)).alias("n"))
