"""robots.txt, sitemaps and llms.txt as DataFrame operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.checkpoints import checkpointed

# Fixed values
SCAN_BOTS = ("oai-searchbot", "claude-searchbot", "perplexitybot", "googlebot")
BOTS = (
    *((b, "search") for b in (*SCAN_BOTS, "bingbot")),
    *((b, "retrieval") for b in ("chatgpt-user", "claude-user", "perplexity-user")),
    *((b, "training") for b in ("gptbot", "claudebot", "google-extended", "applebot-extended", "ccbot")),
)
LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
SITEMAP_ROOT = r"(?i)<urlset\b|<sitemapindex\b"


def directives(robots: DataFrame, key: str = "site", text: str = "text") -> DataFrame:
    """(site, pos, field, value): the lines that say something, without comments, field in small letters."""
    lines = robots.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("pos", "line"))
    bare = lines.withColumn("line", F.trim(F.substring_index("line", "#", 1))).where(F.contains("line", F.lit(":")))
    colon = F.instr("line", ":")
    return bare.select(key, "pos", F.lower(F.trim(F.expr("substring(line, 1, instr(line, ':') - 1)"))).alias("field"), F.trim(F.substring("line", colon + 1, F.length("line"))).alias("value"))


def parse_rules(robots: DataFrame, key: str = "site", text: str = "text") -> DataFrame:
    """(site, agent, pos, action, path). Consecutive user-agent lines share the rules that follow; blank lines end
    nothing, any other directive ends the list of agents; rules before any agent are dropped, and an agent
    without rules has no row."""
    order = W.partitionBy(key).orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    told = directives(robots, key, text).withColumn("agent_line", is_agent)
    starts = is_agent & ~F.coalesce(F.lag("agent_line").over(order), F.lit(False))
    grouped = told.withColumn("block", F.sum(starts.cast("int")).over(order))
    agents = grouped.where("agent_line").select(key, "block", F.lower("value").alias("agent"))
    rules = grouped.where("field in ('allow', 'disallow')").select(key, "block", "pos", F.col("field").alias("action"), F.col("value").alias("path"))
    return rules.join(agents, [key, "block"]).select(key, "agent", "pos", "action", "path")


def sitemap_lines(robots: DataFrame, key: str = "site", text: str = "text") -> DataFrame:
    return directives(robots, key, text).where("field = 'sitemap'").select(key, "pos", F.col("value").alias("sitemap"))


def rule_pattern(path: Column) -> Column:
    """A rule's path as a regular expression: * is any text, a last $ the end."""
    bare = F.when(path.endswith("$"), F.expr("substring(path, 1, length(path) - 1)")).otherwise(path)
    safe = F.regexp_replace(bare, r"([|\\{}()\[\]^$+?.])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(safe, F.lit("*"), F.lit(".*")), F.when(path.endswith("$"), "$").otherwise(""))


def specificity(path: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"\*", ""))


def _literal(path: Column) -> Column:
    """What a rule's path begins with before its first * or last $."""
    return F.substring_index(F.regexp_replace(path, r"\$$", ""), "*", 1)


def access(rules: DataFrame, asked: DataFrame, key: str = "site") -> DataFrame:
    """asked (site, agent, path) with verdict allowed or blocked and explicit: whether the agent has rules of its own,
    else those of * count. The longest matching rule decides, allow among equals; without one all is allowed.

    Rules are looked up by what they begin with: a path meets only those rules whose literal beginning it has, through a join
    on that beginning, and these are then tried; so a site's rules times its paths is never formed."""
    ready = rules.where("path <> ''").select(key, F.col("agent").alias("follows"), "action", rule_pattern(F.col("path")).alias("pattern"), specificity(F.col("path")).alias("length"), _literal(F.col("path")).alias("begins")).distinct()
    longest = ready.groupBy(key, "follows").agg(F.max(F.length("begins")).alias("longest"))
    own = rules.select(key, "agent").distinct().withColumn("explicit", F.lit(True))
    named = asked.join(own, [key, "agent"], "left").withColumn("explicit", F.coalesce("explicit", F.lit(False)))
    named = named.withColumn("follows", F.when(F.col("explicit"), F.col("agent")).otherwise("*"))
    each = named.select(key, "follows", "path").distinct().join(longest, [key, "follows"])
    lengths = F.sequence(F.lit(0), F.least("longest", F.length("path")))
    begun = each.withColumn("n", F.explode(lengths)).select(key, "follows", "path", F.left("path", "n").alias("begins"))
    met = begun.join(ready, [key, "follows", "begins"]).where(F.expr("path rlike pattern"))
    best = met.groupBy(key, "follows", "path").agg(F.max(F.struct(F.col("length"), (F.col("action") == "allow").alias("allow"))).alias("best"))
    told = named.join(best, [key, "follows", "path"], "left")
    return told.select(key, "agent", "path", "explicit", F.when(~F.col("best.allow"), "blocked").otherwise("allowed").alias("verdict")).distinct()


def bot_access(robots: DataFrame, bots=BOTS, key: str = "site") -> DataFrame:
    """(site, agent, kind, access) for every site and bot; robots has (site, ok, status, text). A missing file (404
    or 410) allows all; another failure leaves access unknown."""
    spark = robots.sparkSession
    known = F.col("ok") | F.col("status").isin(404, 410)
    sites = robots.select(key, F.coalesce(known, F.lit(False)).alias("known"), F.when(F.col("ok"), F.col("text")).alias("text"))
    dim = spark.createDataFrame(list(bots), "agent string, kind string")
    asked = sites.select(key, "known").crossJoin(F.broadcast(dim)).withColumn("path", F.lit("/"))  # 13 fixed rows
    told = access(parse_rules(sites, key), asked.select(key, "agent", "path"), key)
    return asked.join(told, [key, "agent", "path"]).select(key, "agent", "kind", F.when(F.col("known"), F.col("verdict")).otherwise("unknown").alias("access"))


def scan_access(robots: DataFrame, scans: DataFrame, bots=SCAN_BOTS, key: str = "site") -> DataFrame:
    """(site, path, allowed, known, status) of scanned pages: how many of the bots robots.txt allows the page, judged by the path with its
    query, whether that is known, and unrestricted, partially_blocked, blocked or unknown. robots: (site, ok, status, text); scans:
    (site, path). A missing file (404 or 410) allows all; after another failure nothing is known and none counts as allowed.
    A site without a row in robots is unknown as well."""
    known = F.coalesce(F.col("ok") | F.col("status").isin(404, 410), F.lit(False))
    files = robots.groupBy(key).agg(F.max(F.struct(known.alias("known"), F.when(F.col("ok"), F.col("text")).alias("text"))).alias("f")).select(key, "f.*")
    dim = robots.sparkSession.createDataFrame([(b,) for b in bots], "agent string")
    asked = scans.select(key, "path").distinct().crossJoin(F.broadcast(dim))  # four fixed rows
    told = access(parse_rules(files, key), asked, key).join(files.select(key, "known"), key, "left")
    counted = told.groupBy(key, "path").agg(F.count_if((F.col("verdict") == "allowed") & F.col("known")).cast("int").alias("allowed"), F.coalesce(F.bool_and("known"), F.lit(False)).alias("known"))
    status = F.when(~F.col("known"), "unknown").when(F.col("allowed") == len(bots), "unrestricted").when(F.col("allowed") > 0, "partially_blocked").otherwise("blocked")
    return counted.withColumn("status", status)


def expand_sitemaps(roots: DataFrame, files: DataFrame, most: int = 5, key: str = "site") -> DataFrame:
    """(site, pos, url): the pages that a site's sitemaps list. An index's first `most` children are looked up in files in turn, and theirs,
    level by level; a sitemap that was seen is not opened again, so cycles end. Missing files, and those that didn't answer well, list
    nothing; a page counts once. roots: (site, url); files: (url, ok, text). pos is the page's place, level by level."""
    there = files.where("ok").groupBy("url").agg(F.max("text").alias("text"))
    level = checkpointed(roots.where("url is not null").select(key, F.col("url"), F.lit("").alias("at")).distinct())
    seen, pages, depth = level.select(key, "url"), None, 0
    while True:
        opened = level.join(there, "url").withColumn("index", F.col("text").rlike(r"(?i)<sitemapindex\b"))
        found = opened.select(key, "at", "index", F.posexplode(locs(F.col("text"))).alias("pos", "loc"))
        place = F.concat("at", F.lpad(F.col("pos").cast("string"), 9, "0"), F.lit("."))
        found = checkpointed(found.select(key, "index", place.alias("at"), F.col("loc").alias("url"), "pos"))
        listed = found.where("not index").select(key, F.lit(depth).alias("depth"), "at", "url")
        pages = listed if pages is None else pages.unionByName(listed)
        children = found.where(F.col("index") & (F.col("pos") < most)).groupBy(key, "url").agg(F.min("at").alias("at"))
        level = checkpointed(children.join(seen, [key, "url"], "left_anti").select(key, "url", "at"))
        if level.isEmpty():
            break
        seen, depth = checkpointed(seen.unionByName(level.select(key, "url"))), depth + 1
    first = pages.groupBy(key, "url").agg(F.min(F.struct("depth", "at")).alias("first"))
    return first.select(key, F.row_number().over(W.partitionBy(key).orderBy("first", "url")).alias("pos"), "url")


def has_sitemap(robots: DataFrame, sitemaps: DataFrame, key: str = "site") -> DataFrame:
    """(site, has_sitemap): whether a sitemap answered well with the root of one, or robots.txt, if it answered well, names one."""
    named = sitemap_lines(robots.where("ok"), key).select(key)
    own = sitemaps.where(F.col("ok") & F.col("text").rlike(SITEMAP_ROOT)).select(key)
    yes = named.unionByName(own).distinct().withColumn("has_sitemap", F.lit(True))
    return robots.select(key).unionByName(sitemaps.select(key)).distinct().join(yes, key, "left").withColumn("has_sitemap", F.coalesce("has_sitemap", F.lit(False)))


def locs(text: Column) -> Column:
    """The addresses of a sitemap's loc elements."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LOC), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def sitemap_urls(sitemaps: DataFrame, key: str = "site", text: str = "text") -> DataFrame:
    """(site, pos, url) from the loc elements of a sitemap."""
    return sitemaps.select(key, F.posexplode(locs(F.col(text))).alias("pos", "url"))
