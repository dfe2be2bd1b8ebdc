"""Scans of pages with structured data, canonical links, robots files and sitemaps, made from the pages table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.checkpoints import checkpointed, written
from auditloom.functions import html, urls
from auditloom.operators import facts, graph, jsonld, robots, rules, site_rows
from auditloom.plans.literals import quoted as q
from auditloom.plans.pages import FACTS_SQL

LD = '<script type="application/ld+json">'
#: What is added to a page, by the rest of its id modulo their number.
MARKUP = (
    "",
    LD + '{"@graph":[{"@type":"https://schema.org/Book","author":{"@type":["http://schema.org/Person","Thing"],"sameAs":["https://x.com/a","https://www.amazon.com/stores/a"]},"image":"https://i.com/1.png"}]}</script><a href="https://www.goodreads.com/x">x</a>',
    LD + '{"@type":"LocalBusiness","makesOffer":{"x":1},"logo":{"url":"http://i.com/2.png"}}</script>',
    LD + '{"@type":"Organization","hasMenu":"","logo":["https://i.com/3.png",{"url":"https://i.com/4.png"},7]}</script><a href="https://notgoodreads.com/">no</a>',
    LD + "{bad</script>",
    LD + '{"@type":"Thing","s":"{\\"@type\\":\\"Book\\"}","hasOfferCatalog":[{}]}</script>' + LD + '"@type"</script>',
    LD + '{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Is <it> there?","acceptedAnswer":{"@type":"Answer","text":"no such text"}},{"@type":"Question","name":""}]}</script>' + LD + '{"@type":"HTTPS://Schema.org/Dentist"}</script>',
    LD + '{"a":[[{"b":{"@type":"Person","url":"https://p.com","jobTitle":"Author","description":"d"}}]],"makesOffer":false}</script>' + LD + '[{"@type":"Book","author":"A","workExample":[{"isbn":"1"}],"image":"/x.png"}]</script>',
    LD + '{"@type":"Book","author":{"@type":"Person","name":"N","sameAs":["https://x.com/a","https://www.amazon.com/stores/a"]},"image":"https://i.com/1.png"}</script><a href="https://www.goodreads.com/x">x</a>',
    LD + '{"@type":["Person"],"sameAs":["https://www.goodreads.com/a","https://bookbub.com/a","https://z.com/a","https://z.com/a"],"jobTitle":"Author"}</script>',
)
#: robots.txt of a site, by the length of its name modulo their number: status and text.
ROBOTS = ((404, None), (200, "User-agent: Googlebot\nDisallow: /\n"), (503, None), (200, "User-agent: *\nDisallow: /en\nAllow: /en/*.html$\nDisallow: /*?page=\nSitemap: https://s.example/map.xml\n"))


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = F.pmod("page_id", F.lit(len(MARKUP)))
    added = F.element_at(F.array(*map(F.lit, MARKUP)), (kind + 1).cast("int"))
    canonical = F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat(F.lit('<link rel="canonical" href="'), F.col("url"), F.lit('">'))).otherwise("")
    return pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), added, canonical))


def _asked(url: Column) -> Column:
    return F.concat(F.when(urls.path(url) == "", "/").otherwise(urls.path(url)), F.when(F.contains(F.substring_index(url, "#", 1), F.lit("?")), F.concat(F.lit("?"), urls.query(url))).otherwise(""))


def site_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' points with what robots.txt says of the scanned path and its query, and whether there is a sitemap."""
    made = facts.page_facts(_made(spark, sf_dir)).withColumn("site", urls.host(F.col("url"))).withColumn("path", _asked(F.col("url")))
    kind = F.pmod(F.length("site"), F.lit(len(ROBOTS)))
    status = F.element_at(F.array(*(F.lit(s) for s, _ in ROBOTS)), (kind + 1).cast("int"))
    text = F.element_at(F.array(*(F.lit(t) for _, t in ROBOTS)), (kind + 1).cast("int"))
    files = made.select("site").distinct().select("site", (status == 200).alias("ok"), status.alias("status"), text.alias("text"))
    maps = files.select("site", F.lit(True).alias("ok"), F.when(F.pmod(F.length("site"), F.lit(5)) == 0, "<urlset>").otherwise("<html>").alias("text"))
    told = made.join(robots.scan_access(files, made.select("site", "path")).select("site", "path", "allowed", "known"), ["site", "path"]).join(robots.has_sitemap(files, maps), "site")
    scanned = facts.scan(told, F.col("allowed"), F.col("known"), F.col("has_sitemap"))
    return scanned.select("page_id", *(f"{k}_points" for k in ("schema", "entity_links", "canonical", "bot_access", "sitemap")), "score")


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nodes of every page's JSON-LD tell."""
    n = F.col("ld.nodes")
    return jsonld.with_nodes(_made(spark, sf_dir)).select(
        "page_id", F.size(n).alias("n_nodes"), F.col("ld.invalid").alias("invalid"), F.size(jsonld.same_as(n)).alias("n_same_as"), jsonld.persons_thin(n).alias("persons_thin"),
        jsonld.books_incomplete(n).alias("books_incomplete"), F.array_join(jsonld.image_urls(n), " ").alias("images"), F.size(jsonld.faq_entries(n)).alias("n_questions"),
    )


#: The rules of the bundle query: those that look beyond a page's markup.
BUNDLE = (
    "ai_search_bot_blocked", "ai_training_bot_blocked", "robots_unavailable", "llms_txt_missing", "llms_txt_no_about_link", "llms_txt_malformed", "bing_verification_not_found", "sameas_thin", "person_schema_thin",
    "schema_image_broken", "faq_schema_mismatch", "book_schema_incomplete", "jsonld_invalid", "retailer_links_thin", "broken_internal_links", "deep_pages", "orphan_pages", "sitemap_missing", "sitemap_not_in_robots",
    "sitemap_broken_urls", "http_not_redirected",
)
BUNDLE_ROBOTS = ((404, None), (200, "User-agent: OAI-SearchBot\nDisallow: /\n\nUser-agent: GPTBot\nDisallow: /\n"), (503, None), (200, "User-agent: *\nAllow: /\nSitemap: https://s.example/map.xml\n"))
BUNDLE_LLMS = (None, "# Name\n\n> What it is.\n\n- [About us](https://s.example/about): who we are\n", "plain words that go on for a while, with no heading, no summary and no link")


def _picked(choices: tuple, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(k, F.lit(len(choices))) + 1).cast("int"))


def bundle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as sites with files and probes that depend on the length of their name, statuses on the page's id; pages link to three others
    each, in the order of their addresses, but every seventh is left out."""
    pages = _made(spark, sf_dir).withColumn("site", urls.host(F.col("url"))).withColumn("status", F.when(F.pmod("page_id", F.lit(11)) == 0, 404).otherwise(200))
    placed = checkpointed(pages.select("site", "url").distinct().withColumn("r", F.row_number().over(W.partitionBy("site").orderBy("url")) - 1))
    above = placed.select("site", F.col("url").alias("src"), F.col("r").alias("up"))
    links = placed.where("r > 0 and r % 7 <> 6").withColumn("up", F.floor((F.col("r") - 1) / 3).cast("int")).join(above, ["site", "up"]).select("site", "src", F.col("url").alias("dst"))
    links = written(links, "links")  # each level of the search reads them
    homes = placed.where("r = 0").select("site", "url")
    found = facts.page_facts(pages.select("page_id", "url", "html", "status")).withColumn("site", urls.host(F.col("url"))).join(graph.depths(links, homes), ["site", "url"], "left").drop("site")
    sited = written(rules.by_site(site_rows.with_jsonld(found, pages.select("page_id", "html"))), "sited")  # read by column, many times
    first = sited.groupBy("site").agg(F.min_by("url", "page_id").alias("homepage")).withColumn("k", F.length("site"))
    k, yes = F.col("k"), F.lit(True)
    status = _picked(tuple(x for x, _ in BUNDLE_ROBOTS), k)
    locs = sited.groupBy("site").agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>")))), ""), F.lit("</urlset>")).alias("text"))
    files = {
        "robots": first.select("site", (status == 200).alias("ok"), status.alias("status"), _picked(tuple(x for _, x in BUNDLE_ROBOTS), k).alias("text")),
        "llms": first.select("site", (k % 3 != 0).alias("ok"), _picked(BUNDLE_LLMS, k).alias("text")),
        "sitemap": first.join(locs, "site").select("site", (k % 3 != 0).alias("ok"), "text"),
        "bing": first.select("site", yes.alias("ok"), F.when(k % 5 == 0, "<users><user>1</user></users>").alias("text")),
        "images": first.select("site", F.concat(F.lit("https://"), "site", F.lit("/logo.png")).alias("url"), F.when(k % 6 == 0, 404).otherwise(200).alias("status")),
        "http": first.select("site", "homepage", yes.alias("ok"), (k % 3 == 0).alias("redirects")),
    }
    extra = checkpointed(site_rows.bundle(sited, pages, links, homes.select("site", F.col("url").alias("homepage"), F.lit(0).alias("uncrawled")), files))
    return rules.issues(sited, extra).where(F.col("rule").isin(*BUNDLE)).select("site", "rule", "severity", "impact", "n_pages")


_MADE = f"""made AS (SELECT page_id, url, coalesce(html, '') || list_extract([{", ".join(map(q, MARKUP))}], page_id % {len(MARKUP)} + 1) || CASE WHEN page_id % 3 = 0 THEN '<link rel="canonical" href="' || url || '">' ELSE '' END AS html FROM pages)"""
TREE_SQL = f"""
blocks AS (SELECT page_id, unnest(regexp_extract_all(html, {q(html.LD_JSON)}, 1)) AS body FROM made),
tree AS (SELECT page_id, j.key, j.type, j.atom, j.path, j.value FROM (SELECT * FROM blocks WHERE json_valid(body)) b, json_tree(b.body) j)"""

NODES_SQL = """
nodes AS (SELECT page_id, value AS o, CASE json_type(value, '$."@type"') WHEN 'VARCHAR' THEN [value ->> '$."@type"'] ELSE value ->> '$."@type"[*]' END AS types FROM tree WHERE type = 'OBJECT' AND json_type(value, '$."@type"') IN ('VARCHAR', 'ARRAY')),
links AS (SELECT page_id, count(DISTINCT l) AS n FROM (SELECT page_id, unnest(CASE json_type(o, '$.sameAs') WHEN 'VARCHAR' THEN [o ->> '$.sameAs'] WHEN 'ARRAY' THEN o ->> '$.sameAs[*]' ELSE [] END) AS l FROM nodes) GROUP BY page_id),
people AS (SELECT page_id, bool_and(coalesce(o ->> '$.url', '') = '' OR (o ->> '$.jobTitle') IS NULL OR (o ->> '$.description') IS NULL) AS thin FROM nodes WHERE list_contains(types, 'Person') GROUP BY page_id),
books AS (SELECT page_id, bool_or((o ->> '$.author') IS NULL OR (o ->> '$.image') IS NULL OR ((o ->> '$.isbn') IS NULL AND coalesce(len(o ->> '$.workExample[*].isbn'), 0) = 0)) AS incomplete FROM nodes WHERE list_contains(types, 'Book') GROUP BY page_id),
pictures AS (SELECT page_id, list_sort(list_distinct(list(i))) AS urls FROM (SELECT page_id, unnest(CASE json_type(v) WHEN 'VARCHAR' THEN [v ->> '$'] WHEN 'OBJECT' THEN [v ->> '$.url'] WHEN 'ARRAY' THEN list_concat(list_filter(v ->> '$[*]', lambda x: x LIKE 'http%'), v ->> '$[*].url') ELSE [] END) AS i
  FROM (SELECT page_id, unnest([o -> '$.logo', o -> '$.image', o -> '$.primaryImageOfPage', o -> '$.thumbnailUrl']) AS v FROM nodes)) WHERE regexp_matches(i, '(?i)^https?://') GROUP BY page_id),
asked AS (SELECT page_id, count(*) AS n FROM nodes WHERE list_contains(types, 'Question') AND coalesce(o ->> '$.name', '') <> '' GROUP BY page_id),
summary AS (SELECT m.page_id, (SELECT count(*) FROM nodes WHERE nodes.page_id = m.page_id)::INT AS n_nodes, (SELECT count(*) FROM blocks WHERE blocks.page_id = m.page_id AND NOT json_valid(body))::INT AS invalid,
  coalesce(links.n, 0)::INT AS n_same_as, coalesce(thin, false) AS persons_thin, coalesce(incomplete, false) AS books_incomplete, coalesce(array_to_string(urls, ' '), '') AS images, coalesce(asked.n, 0)::INT AS n_questions
  FROM made m LEFT JOIN links USING (page_id) LEFT JOIN people USING (page_id) LEFT JOIN books USING (page_id) LEFT JOIN pictures USING (page_id) LEFT JOIN asked USING (page_id))"""

SQL = {
    "site_scans": f"""WITH {_MADE}, {FACTS_SQL.replace("FROM pages)", "FROM made)")}, {TREE_SQL},
types AS (SELECT page_id, list(DISTINCT regexp_replace(json_extract_string(atom, '$'), '(?i)^https?://schema[.]org/', '')) AS t FROM tree WHERE type = 'VARCHAR' AND (key = '@type' OR path LIKE '%"@type"') GROUP BY page_id),
offers AS (SELECT DISTINCT page_id, true AS offers FROM tree WHERE key IN ('hasOfferCatalog', 'makesOffer', 'hasMenu') AND (type IN ('OBJECT', 'ARRAY') OR value::VARCHAR NOT IN ('""', 'false', 'null', '0'))),
flags AS (SELECT f.*, coalesce(list_contains(t, 'Book'), false) AS book, coalesce(list_contains(t, 'Person'), false) AS person, coalesce(list_contains(t, 'FAQPage'), false) AS faq, coalesce(list_has_any(t, ['LocalBusiness', 'Organization', 'Dentist']), false) AS org, coalesce(offers, false) AS offer,
  length(host) % 4 AS robots, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS asked FROM facts f LEFT JOIN types USING (page_id) LEFT JOIN offers USING (page_id)),
points AS (SELECT *, CASE WHEN book AND person OR org AND (offer OR faq) THEN 25 WHEN book OR person OR org OR offer OR faq THEN 12 ELSE 0 END AS schema_points,
  CASE WHEN len(list_filter(hrefs, lambda h: regexp_matches(h, '^https://(www[.])?goodreads[.]com/'))) > 0 THEN 10 ELSE 0 END AS entity_links_points, CASE WHEN page_id % 3 = 0 THEN 15 ELSE 0 END AS canonical_points,
  CASE robots WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 0 ELSE CASE WHEN regexp_matches(asked, '^/en/.*[.]html$') THEN 10 WHEN asked LIKE '/en%' OR regexp_matches(asked, '[?]page=') THEN 0 ELSE 10 END END AS bot_access_points,
  CASE WHEN robots = 3 OR length(host) % 5 = 0 THEN 5 ELSE 0 END AS sitemap_points,
  CASE WHEN h1_count = 1 THEN CASE WHEN h2_count > 0 THEN 15 ELSE 10 END WHEN h1_count > 1 THEN 5 ELSE 0 END + CASE og_present WHEN 3 THEN 10 WHEN 0 THEN 0 ELSE 5 END + CASE WHEN word_count >= 300 THEN 10 WHEN word_count >= 150 THEN 5 ELSE 0 END AS others FROM flags)
SELECT page_id, schema_points, entity_links_points, canonical_points, bot_access_points, sitemap_points, least(100, schema_points + entity_links_points + canonical_points + bot_access_points + sitemap_points + others) AS score FROM points""",
    "page_nodes": f"WITH {_MADE}, {TREE_SQL}, {NODES_SQL} SELECT * FROM summary",
}

SQL["bundle_issues"] = f"""WITH RECURSIVE {_MADE}, {TREE_SQL},
p AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site, page_id % 11 <> 0 AS ok, page_id % 10 AS kind, dense_rank() OVER (PARTITION BY lower(regexp_extract(url, '://([^/?#]*)', 1)) ORDER BY url) - 1 AS r FROM made),
tree_depth(site, r, depth) AS (SELECT DISTINCT site, 0::BIGINT, 0 FROM p UNION SELECT p.site, p.r, depth + 1 FROM tree_depth t JOIN p ON p.site = t.site AND p.r > 0 AND p.r % 7 <> 6 AND (p.r - 1) // 3 = t.r),
sites AS (SELECT site, length(site) AS k, min_by(url, page_id) AS home, count(*) FILTER (ok AND kind = 7) AS sevens, count(*) FILTER (ok AND kind = 8) AS eights, count(*) FILTER (ok AND kind = 9) AS nines FROM p GROUP BY site),
invalid AS (SELECT p.site, count(DISTINCT page_id) AS n FROM p JOIN blocks USING (page_id) WHERE ok AND NOT json_valid(body) GROUP BY p.site),
found AS (
  SELECT site, 'ai_search_bot_blocked' AS rule, 0 AS n FROM sites WHERE k % 4 = 1 UNION ALL SELECT site, 'ai_training_bot_blocked', 0 FROM sites WHERE k % 4 = 1 UNION ALL SELECT site, 'robots_unavailable', 0 FROM sites WHERE k % 4 = 2
  UNION ALL SELECT site, 'llms_txt_missing', 0 FROM sites WHERE k % 3 = 0 UNION ALL SELECT site, unnest(['llms_txt_no_about_link', 'llms_txt_malformed']), 0 FROM sites WHERE k % 3 = 2
  UNION ALL SELECT site, 'bing_verification_not_found', 0 FROM sites WHERE k % 5 <> 0
  UNION ALL SELECT site, 'sameas_thin', 0 FROM sites WHERE sevens + eights > 0 AND nines = 0 UNION ALL SELECT site, 'person_schema_thin', eights + nines FROM sites WHERE eights + nines > 0 AND sevens = 0
  UNION ALL SELECT site, 'schema_image_broken', 1 FROM sites WHERE k % 6 = 0 UNION ALL SELECT site, 'retailer_links_thin', 0 FROM sites WHERE eights + nines = 0
  UNION ALL SELECT site, 'faq_schema_mismatch', count(*) FROM p WHERE ok AND kind = 6 GROUP BY site UNION ALL SELECT site, 'book_schema_incomplete', count(*) FROM p WHERE ok AND kind = 8 GROUP BY site
  UNION ALL SELECT site, 'jsonld_invalid', n FROM invalid UNION ALL SELECT site, 'broken_internal_links', count(*) FROM p WHERE NOT ok GROUP BY site
  UNION ALL SELECT site, 'deep_pages', count(*) FROM p JOIN tree_depth USING (site, r) WHERE ok AND depth > 3 GROUP BY site
  UNION ALL SELECT site, 'orphan_pages', count(*) FROM p JOIN sites USING (site) WHERE ok AND k % 3 <> 0 AND r % 7 = 6 GROUP BY site
  UNION ALL SELECT site, 'sitemap_missing', 0 FROM sites WHERE k % 3 = 0 UNION ALL SELECT site, 'sitemap_not_in_robots', 0 FROM sites WHERE k % 3 <> 0 AND k % 4 <> 3
  UNION ALL SELECT site, 'sitemap_broken_urls', count(*) FROM p JOIN sites USING (site) WHERE NOT ok AND k % 3 <> 0 GROUP BY site
  UNION ALL SELECT site, 'http_not_redirected', 0 FROM sites WHERE home LIKE 'https://%' AND k % 3 <> 0),
known(rule, severity, impact) AS (VALUES ('ai_search_bot_blocked', 'warning', 3), {", ".join(f"({q(r[0])}, {q(r[2])}, {r[3]})" for r in rules.RULES if r[0] != "ai_search_bot_blocked")})
SELECT site, rule, severity, impact, n AS n_pages FROM found JOIN known USING (rule)"""

QUERIES = {f.__name__: f for f in (site_scans, page_nodes, bundle_issues)}
