"""Queries on the pages table, with SQL twins built from the same patterns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.checkpoints import written
from auditloom.functions import html, urls
from auditloom.operators import artifacts, facts, rules
from auditloom.plans.literals import quoted as q
from auditloom.sources import lists


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.page_facts(_pages(spark, sf_dir))


def scan_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured sites answer robots.txt with 404, which allows all four bots, and have no sitemap."""
    scanned = facts.scan(_facts(spark, sf_dir), F.lit(4), F.lit(True), F.lit(False))
    return scanned.select("page_id", "url", "title", "word_count", "h1_count", "h2_count", *(f"{k}_points" for k in ("schema", "headings", "entity_links", "open_graph", "canonical", "content", "bot_access", "sitemap")), "score", "grade")


def scan_grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scan_score(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("n"), F.sum("score").cast("bigint").alias("total"))
    return scored


def page_facts_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("page_id", "title", "lang", "h1_count", "h2_count", "link_count", "word_count", "description", "viewport", "canonical", "semantic_count", "has_main", "img_count", "script_count", "og_present")


def link_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("url")
    links = _facts(spark, sf_dir).select("page_id", "url", F.explode("hrefs").alias("href"))
    return links.select("page_id", urls.normalize_link(F.col("href"), base, urls.strip_www(urls.host(base))).alias("link")).where("link is not null").distinct()


def link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("page_id", F.explode(facts.link_hosts(F.col("url"), F.col("hrefs"))).alias("host"))


def title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.duplicates(_facts(spark, sf_dir).withColumn("site", urls.host(F.col("url"))), "title").select("site", "page_id", "url", F.lower("title").alias("value"))


def title_length_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("page_id", F.length("title").alias("n_chars")).where("n_chars > 0 and (n_chars < 10 or n_chars > 70)")


def thin_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where("word_count < 300").select("page_id", "word_count")


def _sited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by site, written once: the rules look at them several times, and the regular expressions are what costs."""
    return written(rules.by_site(_facts(spark, sf_dir)), "sited")


def issues_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host is a site, its page with the least id the homepage."""
    found = rules.ranked(rules.issues(_sited(spark, sf_dir)))
    return found.select("site", "rank", "rule", "category", "severity", "impact", "effort", "priority", "quadrant", "n_pages")


def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sited = _sited(spark, sf_dir)
    found = rules.hits(sited)
    return rules.site_scores(rules.issues(sited, found=found), rules.issue_pages(sited, found=found), sited)


def quadrant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quadrant_counts(rules.issues(_sited(spark, sf_dir)))


def issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.issue_pages(_sited(spark, sf_dir)).select("site", "rule", "url")


def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    sited = _sited(spark, sf_dir)
    return artifacts.inventory(sited, rules.issue_pages(sited)).select("page_id", "title", "n_issues")


def site_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overview file for each host; its homepage is the page with the least id."""
    sited = rules.by_site(_facts(spark, sf_dir))
    homes = sited.groupBy("site").agg(F.min_by(F.struct("title", "description", "url"), "ord").alias("h"))
    names = homes.select("site", artifacts.guess_name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("h.title")).alias("name"), F.col("h.description").alias("description"), F.col("h.url").alias("home"))
    return artifacts.overview(sited, names)


def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a batch scan's CSV file."""
    scanned = facts.scan(_facts(spark, sf_dir), F.lit(4), F.lit(True), F.lit(False)).withColumn("status", F.lit(200))
    return lists.csv_rows(artifacts.flat_rows(scanned.select("url", "status", "score", "grade", "h1_count", "h2_count", "word_count")))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.page_hits(_sited(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n_pages"))


# SQL twins

_DECODED = "{}"
for _entity, _char in html.ENTITIES:
    _DECODED = f"replace({_DECODED}, {q(_entity)}, {q(_char)})"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(html.SPACES)}, ' ', 'g'))"


def _meta(attribute: str, name: str) -> str:
    return _collapsed(_DECODED.format(f"regexp_extract(regexp_extract(markup, {q(html.meta_tag(attribute, name))}, 0), {q(html.CONTENT_VALUE)}, 1)"))


def _count(markup: str, tag: str) -> str:
    return f"len(regexp_extract_all({markup}, {q(rf'(?is)<{tag}[\s/>]')}))"


FACTS_SQL = f"""
seen AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), {q(html.COMMENT)}, '', 'g') AS seen FROM pages),
cleaned AS (SELECT *, regexp_replace(seen, {q(html.RAW_ELEMENTS)}, '', 'g') AS markup FROM seen),
texts AS (SELECT *, {_collapsed(_DECODED.format(f"regexp_replace(regexp_replace(markup, {q(r'(?is)^.*?<body\b[^>]*>')}, ''), {q(html.TAG)}, '', 'g')"))} AS txt,
  {_collapsed(_DECODED.format(f"regexp_extract(markup, {q(html.TITLE)}, 1)"))} AS title FROM cleaned),
facts AS (SELECT page_id, url, title, regexp_extract(markup, {q(html.LANG)}, 1) AS lang,
  {_count("markup", "h1")}::INT AS h1_count, {_count("markup", "h2")}::INT AS h2_count,
  regexp_extract_all(markup, {q(html.HREF)}, 1) AS hrefs,
  CASE WHEN txt = '' THEN 0 ELSE len(string_split(txt, ' ')) END::INT AS word_count,
  {_meta("name", "description")} AS description, {_meta("name", "viewport")} <> '' AS viewport,
  regexp_extract(regexp_extract(markup, {q(html.CANONICAL_TAG)}, 0), {q(html.HREF_VALUE)}, 1) AS canonical,
  ({" + ".join(_count("markup", t) for t in html.SEMANTIC_TAGS)})::INT AS semantic_count,
  ({_count("markup", "main")} + {_count("markup", "article")}) > 0 AS has_main,
  {_count("markup", "img")}::INT AS img_count,
  ({_count("seen", "script")} - len(regexp_extract_all(seen, {q(html.LD_JSON)})))::INT AS script_count,
  ({" + ".join(f"({_meta('property', p)} <> '')::INT" for p in facts.OPEN_GRAPH)})::INT AS og_present,
  regexp_extract(url, {q(urls.PARTS)}, 1) AS scheme, lower(regexp_extract(url, {q(urls.PARTS)}, 2)) AS host
  FROM texts)"""

# no page of the tables has JSON-LD, a canonical link or a link to another host
SCORED_SQL = f"""WITH {FACTS_SQL},
points AS (SELECT *, 0 AS schema_points, CASE WHEN h1_count = 1 THEN CASE WHEN h2_count > 0 THEN 15 ELSE 10 END WHEN h1_count > 1 THEN 5 ELSE 0 END AS headings_points,
  CASE WHEN len(list_filter(hrefs, lambda x: regexp_matches(x, '(?i)^https?://'))) > 0 THEN NULL ELSE 0 END AS entity_links_points,
  CASE og_present WHEN 3 THEN 10 WHEN 0 THEN 0 ELSE 5 END AS open_graph_points,
  CASE WHEN canonical = '' THEN 0 END AS canonical_points,
  CASE WHEN word_count >= 300 THEN 10 WHEN word_count >= 150 THEN 5 ELSE 0 END AS content_points, 10 AS bot_access_points, 0 AS sitemap_points FROM facts),
scored AS (SELECT *, schema_points + headings_points + entity_links_points + open_graph_points + canonical_points + content_points + bot_access_points + sitemap_points AS score FROM points),
graded AS (SELECT *, CASE WHEN score >= 85 THEN 'A (Strong Foundations)' WHEN score >= 70 THEN 'B (Good, Some Gaps)' WHEN score >= 50 THEN 'C (Major Gaps)' ELSE 'D (Limited Signals)' END AS grade FROM scored)
"""

HITS_SQL = f"""WITH {FACTS_SQL},
sited AS (SELECT *, host AS site, row_number() OVER (PARTITION BY host ORDER BY page_id) AS ord,
  CASE WHEN title <> '' THEN count(*) OVER (PARTITION BY host, lower(title)) ELSE 0 END AS titles,
  CASE WHEN description <> '' THEN count(*) OVER (PARTITION BY host, lower(description)) ELSE 0 END AS descriptions,
  CASE WHEN regexp_extract(url, {q(urls.PARTS)}, 3) = '' THEN '/' ELSE regexp_extract(url, {q(urls.PARTS)}, 3) END AS path FROM facts),
hits AS (SELECT site, ord, url, unnest(list_filter([
  CASE WHEN og_present < 3 AND NOT utility THEN 'open_graph_missing' END,
  CASE WHEN word_count < 300 AND NOT utility THEN 'thin_content' END,
  CASE WHEN word_count > 5000 THEN 'content_too_long' END,
  CASE WHEN NOT has_main AND semantic_count < 2 AND NOT utility THEN 'low_semantic_html' END,
  CASE WHEN title = '' THEN 'title_missing' END,
  CASE WHEN titles > 1 THEN 'title_duplicate' END,
  CASE WHEN title <> '' AND (length(title) < 10 OR length(title) > 70) THEN 'title_length' END,
  CASE WHEN description = '' THEN 'meta_description_missing' END,
  CASE WHEN descriptions > 1 THEN 'meta_description_duplicate' END,
  CASE WHEN h1_count = 0 THEN 'h1_missing' END,
  CASE WHEN h1_count > 1 THEN 'h1_multiple' END,
  CASE WHEN canonical = '' THEN 'canonical_missing' END,
  CASE WHEN NOT viewport THEN 'viewport_missing' END,
  CASE WHEN lang = '' THEN 'lang_missing' END,
  CASE WHEN word_count < 50 AND script_count >= 5 THEN 'js_rendered_shell' END], lambda x: x IS NOT NULL)) AS rule
  FROM (SELECT *, regexp_matches(path, {q(rules.UTILITY_PATH)}) AS utility FROM sited))"""

# the tables have neither JSON-LD nor links to shops, so these two and the shop rule hold for every site
ISSUES_SQL = HITS_SQL + f""",
homes AS (SELECT site, min_by(url, ord) AS home, bool_or(regexp_matches(path, '(?i)/(about|bio|author|meet)')) AS about, count(*) AS pages FROM sited GROUP BY site),
dim(rule_ord, rule, category, severity, impact, effort) AS (VALUES {", ".join(f"({i}, {q(r[0])}, {q(r[1])}, {q(r[2])}, {r[3]}, {r[4]})" for i, r in enumerate(rules.RULES, 1))}),
found AS (SELECT site, rule, list(url) AS pages FROM hits GROUP BY site, rule
  UNION ALL SELECT site, 'person_schema_missing', [home] FROM homes
  UNION ALL SELECT site, unnest(['book_schema_missing', 'retailer_links_thin']), []::VARCHAR[] FROM homes
  UNION ALL SELECT site, 'about_page_missing', [] FROM homes WHERE NOT about
  UNION ALL SELECT site, 'not_https', [] FROM homes WHERE home NOT LIKE 'https://%'),
weighed AS (SELECT *, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS weight FROM found JOIN dim USING (rule)),
issues AS (SELECT *, round(impact * weight * 10 / effort)::INT AS priority,
  CASE WHEN impact >= 3 THEN CASE WHEN effort <= 2 THEN 'Quick win' ELSE 'Major project' END WHEN effort <= 2 THEN 'Fill-in' ELSE 'Deprioritize' END AS quadrant FROM weighed)
"""

SQL = {
    "rule_hits": HITS_SQL + " SELECT rule, count(*) AS n_pages FROM hits GROUP BY rule",
    "issues_ranked": ISSUES_SQL + "SELECT site, row_number() OVER (PARTITION BY site ORDER BY priority DESC, weight DESC, rule_ord) AS rank, rule, category, severity, impact, effort, priority, quadrant, len(pages) AS n_pages FROM issues",
    "quadrant_counts": ISSUES_SQL + "SELECT v.quadrant, count(issues.rule) AS n FROM (VALUES ('Quick win'), ('Major project'), ('Fill-in'), ('Deprioritize')) v(quadrant) LEFT JOIN issues USING (quadrant) GROUP BY v.quadrant",
    "issue_pages": ISSUES_SQL + "SELECT site, rule, unnest(pages) AS url FROM issues",
    "page_inventory": ISSUES_SQL + ", hit AS (SELECT url, count(DISTINCT rule) AS n FROM (SELECT rule, unnest(pages) AS url FROM issues) GROUP BY url) SELECT page_id, title, coalesce(n, 0) AS n_issues FROM facts LEFT JOIN hit USING (url)",
    "scan_rows": SCORED_SQL + """SELECT CASE WHEN regexp_matches(url, '[",\n]') THEN '"' || replace(url, '"', '""') || '"' ELSE url END || ',200,' || score || ',' || CASE WHEN grade LIKE '%,%' THEN '"' || grade || '"' ELSE grade END || ',,,,,' || h1_count || ',' || h2_count || ',,,,,,,,,,,' || word_count || ',,,' AS line FROM graded""",
    "site_scores": ISSUES_SQL + """, touched AS (SELECT site, count(DISTINCT p) AS touched FROM (SELECT site, unnest(pages) AS p FROM issues WHERE severity = 'error') GROUP BY site),
sums AS (SELECT site, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'notice') AS notices,
  count(*) FILTER (severity = 'error' AND len(pages) = 0) AS wide, coalesce(sum(impact * weight) FILTER (category IN ('AI access', 'Entity & schema', 'Content') OR rule IN ('js_rendered_shell', 'noindex')), 0) AS penalty FROM issues GROUP BY site)
SELECT site, homes.pages, errors, warnings, notices, greatest(0, round(100.0 * (homes.pages - coalesce(touched, 0)) / homes.pages) - 10 * wide)::INT AS site_health, greatest(0, 100 - penalty)::INT AS ai_readiness
FROM homes JOIN sums USING (site) LEFT JOIN touched USING (site)""",
    "scan_score": SCORED_SQL + "SELECT page_id, url, title, word_count, h1_count, h2_count, schema_points, headings_points, entity_links_points, open_graph_points, canonical_points, content_points, bot_access_points, sitemap_points, score, grade FROM graded",
    "scan_grade_counts": SCORED_SQL + "SELECT grade, count(*) AS n, sum(score)::BIGINT AS total FROM graded GROUP BY grade",
    "page_facts_native": f"WITH {FACTS_SQL} SELECT page_id, title, lang, h1_count, h2_count, len(hrefs)::INT AS link_count, word_count, description, viewport, canonical, semantic_count, has_main, img_count, script_count, og_present FROM facts",
    "link_normalize": f"WITH {FACTS_SQL}, links AS (SELECT page_id, scheme, host, unnest(hrefs) AS href FROM facts) SELECT DISTINCT page_id, scheme || '://' || host || regexp_replace(regexp_replace(href, '[?#].*$', ''), '(.)/$', '\\1') AS link FROM links WHERE href LIKE '/%' AND NOT regexp_matches(regexp_replace(href, '[?#].*$', ''), {q(urls.NOT_PAGES)})",
    "link_hosts": f"WITH {FACTS_SQL} SELECT page_id, host FROM facts WHERE len(hrefs) > 0",
    "title_duplicates": f"WITH {FACTS_SQL}, counted AS (SELECT host AS site, page_id, url, lower(title) AS value, count(*) OVER (PARTITION BY host, lower(title)) AS n FROM facts WHERE title <> '') SELECT site, page_id, url, value FROM counted WHERE n > 1",
    "title_length_issue": f"WITH {FACTS_SQL} SELECT page_id, length(title)::INT AS n_chars FROM facts WHERE length(title) > 0 AND (length(title) < 10 OR length(title) > 70)",
    "thin_content": f"WITH {FACTS_SQL} SELECT page_id, word_count FROM facts WHERE word_count < 300",
}

QUERIES = {f.__name__: f for f in (scan_score, scan_grade_counts, page_facts_native, link_normalize, link_hosts, title_duplicates, title_length_issue, thin_content, issues_ranked, site_scores, quadrant_counts, issue_pages, page_inventory, site_overviews, scan_rows, rule_hits)}
