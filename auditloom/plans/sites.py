"""Queries on literal robots files, sitemaps, JSON-LD and crawl graphs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import html, scoring, urls, validation
from auditloom.operators import graph, jsonld, robots
from auditloom.plans.literals import frame, quoted, table
from auditloom.plans.scans import NODES_SQL, TREE_SQL

ROBOTS = [
    ("specific", True, 200, "User-agent: *\nDisallow: /\n\nUser-agent: OAI-SearchBot\nAllow: /"),
    ("grouped", True, 200, "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nSitemap: https://g.example/sitemap.xml\nUser-agent: *   # everyone\nDisallow: /drafts"),
    ("blocked", True, 200, "User-agent: *\r\nDisallow: /"),
    ("empty", True, 200, ""),
    ("missing", False, 404, None),
    ("broken", False, 503, None),
    ("training", True, 200, "User-agent: GPTBot\nDisallow: /\n\nUser-agent: ClaudeBot\nDisallow: /\n\nUser-agent: Google-Extended\nDisallow: /\n\nUser-agent: *\nAllow: /"),
    ("stray", True, 200, "Disallow: /early\nUser-agent: Bingbot\nCrawl-delay: 5\nDisallow: /a\n# note\nUser-agent: Googlebot\nUser-agent: Bingbot\nDisallow: /b"),
]
RULES = [
    ("s", "*", 1, "disallow", "/shop/"), ("s", "*", 2, "allow", "/shop/new/"), ("s", "w", 1, "disallow", "/shop/*"), ("s", "w", 2, "allow", "/shop/door$"),
    ("s", "t", 1, "disallow", "/x"), ("s", "t", 2, "allow", "/x"), ("s", "e", 1, "disallow", ""), ("s", "q", 1, "disallow", "/find?q=*&p"),
]
ASKED = [
    ("s", "any", "/shop/old/"), ("s", "any", "/shop/new/7"), ("s", "any", "/"), ("s", "w", "/shop/door"), ("s", "w", "/shop/door/1"),
    ("s", "t", "/x/y"), ("s", "e", "/shop/old/"), ("s", "q", "/find?q=1&p=2"), ("s", "q", "/findXq=1&p"),
]
SITEMAPS = [("a", "<urlset><url><loc>https://a.com/</loc></url><url><loc>\n https://a.com/b?x=1&amp;y=2 </loc></url></urlset>"), ("b", "<p>none</p>"), ("c", None)]
LLMS = [(1, "# Maple Street Press\n\n> Small books about trees.\n\n- [Who we are](https://a.com/team): people"), (2, "plain text"), (3, "intro\n# Later\nno link"), (4, "> only a summary\n[x](https://a.com)")]
LD_PAGES = [
    (1, "https://a.com/", '<script type="application/ld+json">{"@graph":[{"@type":"Person","name":"Jane","url":"https://a.com","jobTitle":"Author","description":"d","sameAs":["https://goodreads.com/j","https://amazon.com/j"]},{"@type":["Book","Product"],"name":"B","author":{"@type":"Person","name":"Jane","sameAs":"https://amazon.com/j"},"workExample":[{"isbn":"978"}],"image":"https://a.com/b.png"}]}</script>'),
    (2, "https://b.com/", '<script type="application/ld+json">{bad json,}</script><script type="application/ld+json">{"@type":"https://schema.org/LocalBusiness","logo":{"url":"http://b.com/l.png"},"makesOffer":{"@type":"Offer"}}</script>'),
    (3, "https://c.com/", "<p>no data</p>"),
    (4, "https://d.com/", '<body>What is it? A book. <script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"What is it?","acceptedAnswer":{"@type":"Answer","text":"A book."}},{"@type":"Question","name":"Hidden question?","acceptedAnswer":{"@type":"Answer","text":"no"}}]}</script></body>'),
]
HOMES = [("s1", "/"), ("s2", "/")]
LINKS = [
    ("s1", "/", "/a"), ("s1", "/a", "/b"), ("s1", "/b", "/c"), ("s1", "/c", "/d"), ("s1", "/d", "/d"), ("s1", "/d", "/e"), ("s1", "/b", "/"), ("s1", "/x", "/a"), ("s1", "/", "/b"),
    ("s2", "/", "/q"), ("s2", "/q", "/"), ("s2", "/q", "/r"),
]
SITE_ROWS = [("s1", "/", 0), ("s2", "/", 10)]
SITEMAP_PAGES = [("s1", "/"), ("s1", "/a"), ("s1", "/x"), ("s1", "/lost"), ("s2", "/alone"), ("s2", "/")]
PROFILE_URLS = [(1, ["https://www.amazon.com/stores/J", "https://netflix.com/x", "https://amzn.to/1", "https://goodreads.com/2", "https://goodreads.com/3"]), (2, ["https://youtu.be/1"]), (3, [])]
CANONICALS = [
    (1, "https://www.example.com/", "https://example.com/"), (2, "/about", "https://example.com/about"), (3, "https://other.com/", "https://example.com/"), (4, None, "https://example.com/"),
    (5, "https://example.com/books/other", "https://example.com/books/mine"), (6, "https://www.example.com/books/mine/", "https://example.com/books/mine"), (7, "https://example.com/index.html?x=1#y", "http://example.com"),
]
LINK_ROWS = [
    (1, "/books/one/#buy", "https://www.author.com/"), (2, "https://author.com/about?utm=x", "https://www.author.com/"), (3, "/cover.jpg", "https://www.author.com/"), (4, "https://other.com/", "https://www.author.com/"),
    (5, "mailto:a@b.co", "https://www.author.com/"), (6, "two", "https://author.com/books/one"), (7, "/", "https://author.com/x/"), (8, "", "https://author.com/x/"),
]


def _robots(spark: SparkSession) -> DataFrame:
    return frame(spark, "site string, ok boolean, status int, text string", ROBOTS)


def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.parse_rules(_robots(spark)).select("site", "agent", "action", "path")


def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.sitemap_lines(_robots(spark)).select("site", "sitemap")


def robots_access_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.access(frame(spark, "site string, agent string, pos int, action string, path string", RULES), frame(spark, "site string, agent string, path string", ASKED))


def bot_access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.bot_access(_robots(spark))


def bot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = robots.bot_access(_robots(spark), [(b, "search") for b in robots.SCAN_BOTS]).groupBy("site").agg(F.count_if(F.col("access") == "allowed").alias("allowed"), F.bool_and(F.col("access") != "unknown").alias("known"))
    return told.select("site", "allowed", scoring.bot_points(F.col("allowed"), F.col("known")).alias("points"))


def sitemap_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.sitemap_urls(frame(spark, "site string, text string", SITEMAPS)).select("site", "url")


def llms_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "id int, text string", LLMS).select("id", F.size(validation.llms_problems(F.col("text"))).alias("n_problems"))


def _nodes(spark: SparkSession) -> DataFrame:
    return jsonld.with_nodes(frame(spark, "page_id int, url string, html string", LD_PAGES))


def jsonld_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _nodes(spark).select("page_id", F.explode(F.transform("ld.nodes", lambda n: n["types"])).alias("types"))
    return found.select("page_id", F.explode("types").alias("type")).groupBy("page_id", "type").agg(F.count("*").alias("n"))


def jsonld_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ld.nodes")
    return _nodes(spark).select(
        "page_id", F.size(n).alias("n_nodes"), F.col("ld.invalid").alias("invalid"), F.size(jsonld.same_as(n)).alias("n_same_as"), jsonld.persons_thin(n).alias("persons_thin"),
        jsonld.books_incomplete(n).alias("books_incomplete"), F.array_join(jsonld.image_urls(n), " ").alias("images"),
    )


def faq_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = html.visible_text(html.without_raw(F.col("html")))
    return _nodes(spark).select("page_id", F.size(jsonld.faq_entries(F.col("ld.nodes"))).alias("n_entries"), F.array_join(validation.faq_mismatch(jsonld.faq_entries(F.col("ld.nodes")), shown), "|").alias("missing"))


def _links(spark: SparkSession) -> DataFrame:
    return frame(spark, "site string, src string, dst string", LINKS)


def crawl_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(_links(spark), frame(spark, "site string, url string", HOMES))


def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.deep_pages(crawl_depth(spark, sf_dir))


def inlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inlinks(_links(spark))


def first_inlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_inlinks(_links(spark), 1).select("site", "url", "source")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frame(spark, "site string, url string", SITEMAP_PAGES)
    return graph.orphans(pages, _links(spark), pages, frame(spark, "site string, homepage string, uncrawled int", SITE_ROWS))


def profile_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "id int, urls array<string>", PROFILE_URLS).select("id", F.explode(graph.profiles(F.col("urls"))).alias("p")).select("id", "p.kind", "p.url")


def canonical_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "id int, href string, page string", CANONICALS).select("id", urls.canonical_correct(F.col("href"), F.col("page")).alias("correct"))


def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "id int, href string, page string", LINK_ROWS).select("id", urls.normalize_link(F.col("href"), F.col("page"), F.lit("author.com")).alias("link"))


_ROBOTS_SQL = f"""WITH {table("robots", "site, ok, status, body", ROBOTS)},
lines AS (SELECT site, pos, trim(split_part(line, '#', 1)) AS line FROM (SELECT site, unnest(string_split_regex(coalesce(body, ''), '\\r?\\n')) AS line, generate_subscripts(string_split_regex(coalesce(body, ''), '\\r?\\n'), 1) AS pos FROM robots)),
told AS (SELECT site, pos, lower(trim(substr(line, 1, instr(line, ':') - 1))) AS field, trim(substr(line, instr(line, ':') + 1)) AS value FROM lines WHERE contains(line, ':')),
marked AS (SELECT *, field = 'user-agent' AS is_agent, coalesce(lag(field) OVER (PARTITION BY site ORDER BY pos) = 'user-agent', false) AS after_agent FROM told),
grouped AS (SELECT *, sum((is_agent AND NOT after_agent)::INT) OVER (PARTITION BY site ORDER BY pos) AS block FROM marked),
rules AS (SELECT r.site, lower(a.value) AS agent, r.pos, r.field AS action, r.value AS path FROM grouped r JOIN grouped a ON r.site = a.site AND r.block = a.block AND a.is_agent WHERE r.field IN ('allow', 'disallow'))"""

_ACCESS_SQL = """
known AS (SELECT DISTINCT site, agent FROM rules),
followed AS (SELECT q.*, k.agent IS NOT NULL AS explicit, coalesce(k.agent, '*') AS follows FROM asked q LEFT JOIN known k USING (site, agent)),
ready AS (SELECT site, agent, action, length(replace(regexp_replace(path, '\\$$', ''), '*', '')) AS len,
  '^' || replace(regexp_replace(CASE WHEN path LIKE '%$' THEN left(path, length(path) - 1) ELSE path END, '([|\\\\{}()\\[\\]^$+?.])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN path LIKE '%$' THEN '$' ELSE '' END AS pattern FROM rules WHERE path <> ''),
best AS (SELECT f.site, f.agent, f.path, any_value(f.explicit) AS explicit, max(CASE WHEN regexp_matches(f.path, r.pattern) THEN r.len * 2 + (r.action = 'allow')::INT END) AS best
  FROM followed f LEFT JOIN ready r ON r.site = f.site AND r.agent = f.follows GROUP BY f.site, f.agent, f.path)"""

_BOTS = table("bots", "agent, kind", robots.BOTS)
_MATRIX = f"""{_ROBOTS_SQL}, {_BOTS},
asked AS (SELECT site, agent, '/' AS path FROM robots CROSS JOIN bots),{_ACCESS_SQL},
matrix AS (SELECT b.site, b.agent, bots.kind, CASE WHEN NOT robots.ok AND robots.status NOT IN (404, 410) THEN 'unknown' WHEN best % 2 = 0 THEN 'blocked' ELSE 'allowed' END AS access
  FROM best b JOIN bots USING (agent) JOIN robots USING (site))"""
_LINKS_SQL = table("links", "site, src, dst", LINKS)
_DEPTHS = f"""WITH RECURSIVE {_LINKS_SQL}, {table("homes", "site, url", HOMES)},
walk(site, url, depth) AS (SELECT site, url, 0 FROM homes UNION SELECT l.site, l.dst, w.depth + 1 FROM walk w JOIN links l ON l.site = w.site AND l.src = w.url WHERE w.depth < 8),
depths AS (SELECT site, url, min(depth) AS depth FROM walk GROUP BY site, url)"""

SQL = {
    "robots_parse": _ROBOTS_SQL + " SELECT site, agent, action, path FROM rules",
    "robots_sitemaps": _ROBOTS_SQL + " SELECT site, value AS sitemap FROM told WHERE field = 'sitemap'",
    "robots_access_paths": f"WITH {table('rules', 'site, agent, pos, action, path', RULES)}, {table('asked', 'site, agent, path', ASKED)},{_ACCESS_SQL} SELECT site, agent, path, explicit, CASE WHEN best % 2 = 0 THEN 'blocked' ELSE 'allowed' END AS verdict FROM best",
    "bot_access_matrix": _MATRIX + " SELECT site, agent, kind, access FROM matrix",
    "bot_points": _MATRIX + f" SELECT site, count(*) FILTER (access = 'allowed') AS allowed, CASE WHEN bool_and(access <> 'unknown') THEN round(10 * count(*) FILTER (access = 'allowed') / 4.0) ELSE 0 END::INT AS points FROM matrix WHERE agent IN ({', '.join(map(quoted, robots.SCAN_BOTS))}) GROUP BY site",
    "sitemap_locs": f"WITH {table('maps', 'site, body', SITEMAPS)} SELECT site, replace(unnest(regexp_extract_all(body, {quoted(robots.LOC)}, 1)), '&amp;', '&') AS url FROM maps",
    "llms_problems": f"""WITH {table("t", "id, body", LLMS)} SELECT id, ((NOT regexp_matches(body, '(?m)^#\\s+\\S'))::INT + (NOT regexp_matches(body, '(?m)^>\\s+\\S'))::INT + (NOT regexp_matches(body, '\\[[^\\]]+\\]\\(https?://[^)]+\\)'))::INT)::INT AS n_problems FROM t""",
    "crawl_depth": _DEPTHS + " SELECT site, url, depth FROM depths",
    "deep_pages": _DEPTHS + " SELECT site, url, depth FROM depths WHERE depth > 3",
    "inlinks": f"WITH {_LINKS_SQL} SELECT site, dst AS url, count(DISTINCT src) AS n_inlinks FROM links WHERE src <> dst GROUP BY site, dst",
    "first_inlinks": f"WITH {_LINKS_SQL} SELECT site, dst AS url, min(src) AS source FROM links WHERE src <> dst GROUP BY site, dst",
    "orphans": f"WITH {_LINKS_SQL}, {table('maps', 'site, url', SITEMAP_PAGES)}, {table('sites', 'site, homepage, uncrawled', SITE_ROWS)} SELECT m.site, m.url FROM maps m JOIN sites s USING (site) WHERE uncrawled = 0 AND url <> homepage AND NOT EXISTS (SELECT 1 FROM links l WHERE l.site = m.site AND l.dst = m.url AND l.src <> l.dst)",
    "canonical_check": f"""WITH {table("t", "id, href, page", CANONICALS)},
parts AS (SELECT id, href, page, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN regexp_extract(page, '^[a-z]+://[^/]*') || href END AS target FROM t),
bare AS (SELECT id, href, target, regexp_replace(lower(regexp_extract(target, '://([^/?#]*)', 1)), '^www\\.', '') AS h1, regexp_replace(lower(regexp_extract(page, '://([^/?#]*)', 1)), '^www\\.', '') AS h2,
  regexp_replace(regexp_replace(regexp_extract(target, '://[^/?#]*([^?#]*)', 1), '(?i)/index\\.html$', '/'), '/+$', '') AS p1, regexp_replace(regexp_replace(regexp_extract(page, '://[^/?#]*([^?#]*)', 1), '(?i)/index\\.html$', '/'), '/+$', '') AS p2 FROM parts)
SELECT id, coalesce(regexp_matches(target, '(?i)^https?://') AND h1 = h2 AND p1 = p2, false) AS correct FROM bare""",
    "link_resolution": f"""WITH {table("t", "id, href, page", LINK_ROWS)},
parts AS (SELECT *, regexp_extract(page, '^[a-z]+://[^/]*') AS origin, regexp_extract(page, '^[a-z]+://[^/]*([^?#]*/)', 1) AS folder FROM t),
full_urls AS (SELECT id, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN origin || href ELSE origin || folder || href END AS f FROM parts),
cut AS (SELECT id, href, f, lower(regexp_extract(f, '://([^/?#]*)', 1)) AS h, regexp_extract(f, '://[^/?#]*([^?#]*)', 1) AS p FROM full_urls)
SELECT id, CASE WHEN href <> '' AND regexp_matches(f, '^https?://') AND regexp_replace(h, '^www\\.', '') = 'author.com' AND NOT regexp_matches(p, {quoted(urls.NOT_PAGES)})
  THEN regexp_extract(f, '^[a-z]+://') || h || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END END AS link FROM cut""",
    "jsonld_types": f"""WITH {table("t", "page_id, url, html", LD_PAGES)},
bodies AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script type="application/ld\\+json">(.*?)</script>', 1)) AS body FROM t),
found AS (SELECT page_id, j.key, j.type, j.atom, j.path FROM (SELECT * FROM bodies WHERE json_valid(body)) b, json_tree(b.body) j),
names AS (SELECT page_id, json_extract_string(atom, '$') AS n FROM found WHERE type = 'VARCHAR' AND (key = '@type' OR path LIKE '%"@type"'))
SELECT page_id, n AS type, count(*) AS n FROM names GROUP BY ALL""",
    # the nodes' SQL is written for the query on all pages; here it reads the literal ones
    "jsonld_summary": f"WITH {table('made', 'page_id, url, html', LD_PAGES)}, {TREE_SQL}, {NODES_SQL} SELECT page_id, n_nodes, invalid, n_same_as, persons_thin, books_incomplete, images FROM summary",
    "faq_mismatch": f"""WITH {table('made', 'page_id, url, html', LD_PAGES)}, {TREE_SQL}, {NODES_SQL},
shown AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) AS t FROM made),
questions AS (SELECT page_id, o ->> '$.name' AS name, left(lower(coalesce(o ->> '$.acceptedAnswer.text', '')), 60) AS answer FROM nodes WHERE list_contains(types, 'Question') AND coalesce(o ->> '$.name', '') <> ''),
lost AS (SELECT page_id, string_agg(name, '|') AS missing FROM questions JOIN shown USING (page_id) WHERE NOT contains(t, lower(name)) OR NOT contains(t, answer) GROUP BY page_id)
SELECT page_id, n_questions AS n_entries, coalesce(missing, '') AS missing FROM summary LEFT JOIN lost USING (page_id)""",
    "profile_detect": f"WITH {table('t', 'id, urls', PROFILE_URLS)}, {table('kinds', 'kind, pattern', graph.PROFILES)}, hits AS (SELECT id, kind, pos, url FROM (SELECT id, unnest(urls) AS url, generate_subscripts(urls, 1) AS pos FROM t) CROSS JOIN kinds WHERE regexp_matches(url, pattern)) SELECT id, kind, min_by(url, pos) AS url FROM hits GROUP BY id, kind",
}

QUERIES = {
    f.__name__: f
    for f in (robots_parse, robots_sitemaps, robots_access_paths, bot_access_matrix, bot_points, sitemap_locs, llms_problems, jsonld_types, jsonld_summary, faq_mismatch, crawl_depth, deep_pages, inlinks, first_inlinks, orphans, profile_detect, canonical_check, link_resolution)
}
