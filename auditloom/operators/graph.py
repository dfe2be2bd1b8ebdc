"""The crawl graph: depths, inlinks, orphans and profiles."""

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.checkpoints import checkpointed

# Fixed values
PROFILES = (
    ("amazon_author", r"(?i)amazon\.[a-z.]+/(stores/|author/|.*/e/|-/e/)"),
    ("amazon", r"(?i)(amazon\.[a-z.]+|amzn\.to)"),
    ("goodreads", r"(?i)goodreads\.com"),
    ("bookbub", r"(?i)bookbub\.com"),
    ("wikipedia", r"(?i)wikipedia\.org"),
    ("wikidata", r"(?i)wikidata\.org"),
    ("instagram", r"(?i)instagram\.com"),
    ("facebook", r"(?i)facebook\.com"),
    ("x_twitter", r"(?i)(twitter\.com|x\.com)/"),
    ("tiktok", r"(?i)tiktok\.com"),
    ("linkedin", r"(?i)linkedin\.com"),
    ("youtube", r"(?i)youtube\.com|youtu\.be"),
    ("substack", r"(?i)substack\.com"),
)


def depths(links: DataFrame, homes: DataFrame, most: int | None = None) -> DataFrame:
    """(site, url, depth): how many links lead from a site's homepage to each page that they reach. A breadth-first
    search of all sites at once: each round joins the last level's pages with their links and keeps those not seen; it
    ends with a round that finds nothing, or, if most is given, at that depth. links: (site, src, dst); homes: (site, url)."""
    seen = checkpointed(homes.select("site", "url").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for depth in count(1) if most is None else range(1, most + 1):
        reached = level.select("site", F.col("url").alias("src")).join(links, ["site", "src"]).select("site", F.col("dst").alias("url")).distinct()
        level = checkpointed(reached.join(seen, ["site", "url"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = checkpointed(seen.unionByName(level))
    return seen


def crawl_order(found: DataFrame, most: int = 30) -> DataFrame:
    """The pages that a crawl of at most `most` pages a site takes: by depth, then in their order (ord); pages known from
    the sitemap alone (null depth) come last."""
    order = W.partitionBy("site").orderBy(F.coalesce("depth", F.lit(99)), "ord")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def inlink_edges(links: DataFrame) -> DataFrame:
    """(site, url, source): who links to a page, itself aside, each source once."""
    return links.where("src <> dst").select("site", F.col("dst").alias("url"), F.col("src").alias("source")).distinct()


def inlinks(links: DataFrame) -> DataFrame:
    """(site, url, n_inlinks)."""
    return inlink_edges(links).groupBy("site", "url").agg(F.count("*").alias("n_inlinks"))


def first_inlinks(links: DataFrame, most: int = 3) -> DataFrame:
    """The first sources of each page, for display."""
    order = W.partitionBy("site", "url").orderBy("source")
    return inlink_edges(links).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def orphans(pages: DataFrame, links: DataFrame, sitemap: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages of the sitemap that no page links to, homepages aside; none for a site that wasn't crawled whole.
    sites: (site, homepage, uncrawled)."""
    whole = sites.where("uncrawled = 0").select("site", "homepage")
    linked = links.where("src <> dst").select("site", F.col("dst").alias("url"))
    listed = pages.join(sitemap, ["site", "url"], "left_semi").join(whole, "site").where("url <> homepage").select("site", "url")
    return listed.join(linked, ["site", "url"], "left_anti")


def deep_pages(found: DataFrame, deepest: int = 3) -> DataFrame:
    return found.where(F.col("depth") > deepest)


def profiles(urls: Column) -> Column:
    """The first URL of each profile kind that occurs: array<struct<kind, url>>, in the order of kinds."""
    found = [F.struct(F.lit(kind).alias("kind"), F.get(F.filter(urls, _matches(pattern)), 0).alias("url")) for kind, pattern in PROFILES]
    return F.filter(F.array(*found), lambda p: p["url"].isNotNull())


def _matches(pattern: str):
    return lambda u: u.rlike(pattern)


def crawl(links: DataFrame, homes: DataFrame, seeds: DataFrame, most: int = 30, found_most: int | None = None) -> DataFrame:
    """(site, url, place, depth, uncrawled): the pages that a crawl visits, in order, of all sites at once.

    A crawl starts at the site's homepage, of depth 0, and knows the seeds (from a sitemap), whose depth is unknown. It always takes the
    page of the least depth, those of unknown depth last, and among equals the one found first. A page's links are found when it is
    visited; each is a level below it, or of unknown depth as it is. At most `most` pages are visited, and no more than found_most
    (3 x most by default) pages are found from links and seeds together: links beyond aren't followed, seeds are all known.
    At the end a page of unknown depth that visited pages of known depth link to is a level below the least of them; pages are
    settled so in their order. uncrawled: how many found pages of the site weren't visited.

    links: (site, src, dst, pos), pos the order on the page, of which equal ones count once; homes: (site, url), the first of a site counts;
    seeds: (site, url, pos). Nulls are left out; a site without a homepage isn't crawled. A round visits all pages of the same level, at
    most `most`; so there are at most that many rounds, whatever the number of sites, and a site has few rows."""
    room = 3 * most if found_most is None else found_most
    links = links.where("site is not null and src is not null and dst is not null")
    start = homes.where("site is not null and url is not null").groupBy("site").agg(F.min("url").alias("url"))
    start = start.select("site", "url", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("ord"))
    known = seeds.where("site is not null and url is not null").join(start.select("site", F.col("url").alias("home")), "site").where("url <> home")
    known = known.groupBy("site", "url").agg(F.min("pos").alias("pos")).withColumn("ord", F.row_number().over(W.partitionBy("site").orderBy("pos", "url")).cast("bigint"))
    unvisited = F.lit(None).cast("int")
    state = checkpointed(start.unionByName(known.select("site", "url", F.lit(None).cast("int").alias("depth"), "ord")).withColumn("place", unvisited))
    order = [F.coalesce("depth", F.lit(1 << 30)), "ord"]
    site = W.partitionBy("site")
    while True:
        level = F.coalesce(F.col("depth"), F.lit(1 << 30))
        told = state.withColumns({"done": F.count("place").over(site), "next": F.min(F.when(F.col("place").isNull(), level)).over(site)})
        due = told.where(F.col("place").isNull() & (level == F.col("next")) & (F.col("done") < most))
        due = due.withColumn("turn", F.row_number().over(site.orderBy(*order))).where(F.col("turn") <= most - F.col("done"))
        visited = checkpointed(due.select("site", "url", "depth", (F.col("done") + F.col("turn")).cast("int").alias("now")))
        if visited.isEmpty():
            break
        out = visited.withColumnRenamed("url", "src").join(links, ["site", "src"])
        out = out.groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("now", "pos")).alias("at"), F.min_by("depth", F.struct("now", "pos")).alias("depth"))
        fresh = out.join(state.select("site", "url"), ["site", "url"], "left_anti")
        sizes = state.groupBy("site").agg(F.count("*").alias("found"), F.max("ord").alias("last"))
        fresh = fresh.withColumn("n", F.row_number().over(site.orderBy("at", "url"))).join(sizes, "site").where(F.col("found") + F.col("n") <= room)
        fresh = fresh.select("site", "url", (F.col("depth") + 1).alias("depth"), (F.col("last") + F.col("n")).alias("ord"), unvisited.alias("place"))
        moved = state.join(visited.select("site", "url", "now"), ["site", "url"], "left").withColumn("place", F.coalesce("place", "now")).drop("now")
        state = checkpointed(moved.unionByName(fresh))
    taken = state.where("place is not null")
    parents = taken.select("site", F.col("url").alias("src"), F.col("place").alias("above"))
    into = checkpointed(links.join(taken.where("depth is null").select("site", F.col("url").alias("dst"), "place"), ["site", "dst"]).join(parents, ["site", "src"]).select("site", "src", "dst", "place", "above").distinct())
    settled = checkpointed(taken.select("site", "url", "depth", "place", F.col("depth").isNotNull().alias("sure")))
    before = None
    while True:
        up = settled.where("depth is not null").select("site", F.col("url").alias("src"), F.col("depth").alias("d"), "sure")
        told = into.join(up, ["site", "src"]).where("sure or above < place").groupBy("site", F.col("dst").alias("url")).agg((F.min("d") + 1).alias("d"))
        settled = checkpointed(settled.join(told, ["site", "url"], "left").withColumn("depth", F.when(F.col("sure"), F.col("depth")).otherwise(F.col("d"))).drop("d"))
        mark = tuple(settled.agg(F.count("depth"), F.sum("depth")).first())
        if mark == before:
            break
        before = mark
    left = state.groupBy("site").agg(F.count_if(F.col("place").isNull()).alias("uncrawled"))
    return settled.join(left, "site").select("site", "url", "place", "depth", "uncrawled")
