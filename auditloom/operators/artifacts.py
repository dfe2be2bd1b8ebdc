"""What a site can publish, made from its facts: overview, robots.txt and JSON-LD drafts; inventories and flat rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions import html, urls, validation
from auditloom.operators.robots import BOTS

# How many pages a section of the overview lists
SECTIONS = (("books", "## Books", 15), ("about", "## About", 3), ("other", "## Pages", 10))
# Fixed value: pages that no overview lists; another pattern than that of the rules
UTILITY_PATH = r"(?i)/(privacy|terms|cookie|refund|cart|checkout|login|account|404)"
TITLE_BREAK = r"\s[|–—-]\s"
SOURCE_CHARS = 8000
COLUMNS = (
    "url", "status", "score", "grade", "has_book_schema", "has_person_schema", "has_faq_schema", "sameas_count", "h1_count", "h2_count", "has_amazon_link", "has_goodreads_link", "has_bookbub_link", "has_open_graph",
    "has_llms_txt", "blocked_bots", "allowed_bots", "has_explicit_rules", "has_sitemap", "canonical_correct", "word_count", "thin_content", "execution_time", "error",
)


def guess_name(person: Column, site_name: Column, title: Column, default: str = "Author Name") -> Column:
    """A Person's name, else the site's, else what the title says before a spaced separator."""
    from_title = F.trim(F.get(F.split(title, TITLE_BREAK), 0))
    filled = [F.nullif(F.trim(c), F.lit("")) for c in (person, site_name, from_title)]
    return F.coalesce(*filled, F.lit(default))


def section_pages(sited: DataFrame) -> DataFrame:
    """(site, section, place, url, line): the pages that an overview lists, each section up to its cap; legal and error
    pages and the homepage of the last section aside."""
    ok = sited.where(F.col("status").between(200, 299) & ~urls.path(F.col("url")).rlike(UTILITY_PATH))
    p = urls.path(F.col("url"))
    section = F.when(p.rlike(r"(?i)/(books?|novels?|series)(/|$)"), "books").when(p.rlike("(?i)/(about|bio|author|meet)"), "about").otherwise("other")
    label = F.coalesce(F.nullif(F.col("title"), F.lit("")), p)
    listed = ok.where((section != "other") | (p != "/")).select("site", section.alias("section"), "ord", "url", validation.markdown_link(label, F.col("url"), F.col("description")).alias("line"))
    caps = F.create_map(*(F.lit(x) for key, _, most in SECTIONS for x in (key, most)))
    place = F.row_number().over(W.partitionBy("site", "section").orderBy("ord"))
    return listed.withColumn("place", place).where(F.col("place") <= F.element_at(caps, F.col("section"))).drop("ord")


def overview(sited: DataFrame, names: DataFrame) -> DataFrame:
    """(site, text): an llms.txt for each site. names: (site, name, description, home). A site's lines are few by the caps."""
    lines = section_pages(sited).groupBy("site").agg(*(F.array_sort(F.collect_list(F.when(F.col("section") == key, F.struct("place", "line")))).alias(key) for key, _, _ in SECTIONS))
    joined = names.join(lines, "site", "left")
    about = F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("The official pages of "), "name", F.lit(".")))
    head = F.array(F.concat(F.lit("# "), "name"), F.lit(""), F.concat(F.lit("> "), about), F.lit(""), F.concat(F.lit("Official website of "), "name", F.lit(": "), "home"), F.lit(""))
    none = F.array().cast("array<string>")
    parts = [head]
    for key, title, _ in SECTIONS:
        found = F.transform(F.coalesce(key, F.array().cast("array<struct<place:int,line:string>>")), lambda x: x["line"])
        parts.append(F.when(F.size(found) > 0, F.concat(F.array(F.lit(title)), found, F.array(F.lit("")))).otherwise(none))
    return joined.select("site", F.array_join(F.concat(*parts), "\n").alias("text"))


def robots_txt(origin: Column) -> Column:
    """Everything allowed, search crawlers by name, and the sitemap."""
    search = "".join(f"User-agent: {bot}\nAllow: /\n\n" for bot, kind in BOTS if kind == "search")
    return F.concat(F.lit("User-agent: *\nAllow: /\n\n" + search + "Sitemap: "), origin, F.lit("/sitemap.xml"))


def person_json(origin: Column, name: Column, description: Column, same_as: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("Person").alias("@type"), F.concat(origin, F.lit("/#person")).alias("@id"), name.alias("name"), origin.alias("url"), F.lit("Author").alias("jobTitle"),
            F.nullif(description, F.lit("")).alias("description"), F.when(F.size(same_as) > 0, same_as).alias("sameAs"),
        )
    )


def book_json(origin: Column, title: Column) -> Column:
    author = F.struct(F.concat(origin, F.lit("/#person")).alias("@id"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Book").alias("@type"), title.alias("name"), author.alias("author"), F.lit("").alias("isbn"), F.lit("").alias("image")))


def inventory(sited: DataFrame, pages_of_issues: DataFrame) -> DataFrame:
    """Each page with the number of its issues."""
    counted = pages_of_issues.select("site", F.substring_index("url", " ", 1).alias("url"), "rule").distinct().groupBy("site", "url").agg(F.count("*").alias("n_issues"))
    return sited.select("site", "page_id", "url", "status", "title", "word_count").join(counted, ["site", "url"], "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))


def flat_rows(scanned: DataFrame) -> DataFrame:
    """The 24 columns of a batch scan's file, lists joined by a bar; what a scan lacks, as one that failed does, is empty."""
    have = {c: scanned[c] for c in COLUMNS if c in scanned.columns}
    joined = {c: F.array_join(v, "|") if scanned.schema[c].dataType.typeName() == "array" else v.cast("string") for c, v in have.items()}
    return scanned.select(*(joined.get(c, F.lit(None).cast("string")).alias(c) for c in COLUMNS))


def model_source(title: Column, description: Column, books: Column, text: Column) -> Column:
    """What a language model reads of a page: labelled parts between blank lines, at most 8,000 characters."""

    def part(label: str, v: Column) -> Column:
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v))

    listed = F.array_join(F.slice(books, 1, 5), "\n")
    return F.substring(F.concat_ws("\n\n", part("Title: ", html.collapse(title)), part("Description: ", html.collapse(description)), part("Books (structured data):\n", listed), part("Page text:\n", text)), 1, SOURCE_CHARS)


def with_footer(body: Column, sender: str, address: Column, link: Column) -> Column:
    return F.concat(body, F.lit(f"\n\n---\nBusiness solicitation from {sender}\n"), address, F.lit('\nTo stop these emails, reply "unsubscribe" or visit: '), link)


def report_html(ranked: DataFrame) -> DataFrame:
    """(site, rank, html): each issue of a site as an escaped block of a report, in its order."""
    block = F.concat(F.lit("<article><h3>"), F.col("rank").cast("string"), F.lit(". "), validation.html_escape(F.col("rule")), F.lit("</h3><p>"), "severity", F.lit(", "), "quadrant", F.lit(", "), F.col("n_pages").cast("string"), F.lit(" page(s)</p></article>"))
    return ranked.select("site", "rank", block.alias("html"))


def sitemap_files(locations: DataFrame, files: DataFrame) -> DataFrame:
    """Sitemap locations (path) without a built file (file): as it is, with .html, or as a folder's index."""
    p = F.regexp_replace("path", "^/|/$", "")
    ways = F.explode(F.array_distinct(F.array(F.when(p == "", "index.html").otherwise(p), F.concat(p, F.lit(".html")), F.concat(p, F.lit("/index.html"))))).alias("file")
    met = locations.select("path", ways).join(files, "file", "left_semi").select("path").distinct()
    return locations.join(met, "path", "left_anti")
